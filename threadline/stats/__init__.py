"""Statistics as aggregates: models, resampling, concentration."""
