"""streaming of the event-sequence engine."""
