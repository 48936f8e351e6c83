"""Landed pages, feeds and payloads to rows."""
