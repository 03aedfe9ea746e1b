"""The hourly panel over a stream."""
