"""streaming of the event-catalog library."""
