"""Structured Streaming: event aggregates and the job state machine."""
