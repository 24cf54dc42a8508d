"""Agent-transcript analytics on Spark."""
