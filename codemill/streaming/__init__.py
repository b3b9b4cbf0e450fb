"""Streams: file changes into the code table, events, sessions, windows."""
