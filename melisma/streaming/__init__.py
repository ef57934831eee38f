"""Streams: play counts and listening sessions."""
