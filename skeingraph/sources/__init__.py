"""Sources of the call-graph engine."""
