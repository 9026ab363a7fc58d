"""Live tail of an event log."""
