"""sources of the event-sequence engine."""
