"""Streams of page edits."""
