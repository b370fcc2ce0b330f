"""Operators on path sets, graphs and time-stamped edges."""
