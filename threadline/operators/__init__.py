"""operators of the event-sequence engine."""
