"""DataFrame operators. Those that need a bound on a small side check it; none collects rows that grow with the data."""
