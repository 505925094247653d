"""Plans of the call-graph engine."""
