"""Multi-step plans and the registered queries that bind operators to tables."""
