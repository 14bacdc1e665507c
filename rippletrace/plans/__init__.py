"""Plans: the whole analysis, test data adapters, and the registered queries."""
