"""plans of the event-catalog library."""
