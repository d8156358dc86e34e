"""sources of the event-catalog library."""
