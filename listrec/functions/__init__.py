"""Column-level operations on the event log."""
