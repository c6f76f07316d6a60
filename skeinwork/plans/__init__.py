"""Query plans over operators, and the registry of queries."""
