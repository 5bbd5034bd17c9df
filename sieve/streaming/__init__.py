"""Streams of messages: the batch expressions over Structured Streaming."""
