"""Multi-operator jobs and the registered queries."""
