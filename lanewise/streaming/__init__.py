"""Micro-batch sinks for new observations."""
