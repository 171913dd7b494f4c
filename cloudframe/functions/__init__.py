"""Column builders: expressions without shuffles."""
