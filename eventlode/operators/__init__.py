"""operators of the event-catalog library."""
