"""functions of the event-sequence engine."""
