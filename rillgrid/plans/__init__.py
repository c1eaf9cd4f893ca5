"""Sessions, views over the shared test tables, and the registered queries."""
