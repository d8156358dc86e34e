"""functions of the event-catalog library."""
