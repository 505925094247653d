"""Operators of the call-graph engine."""
