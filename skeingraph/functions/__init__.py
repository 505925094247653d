"""Functions of the call-graph engine."""
