"""Operators over panels, ticks, bars and events."""
