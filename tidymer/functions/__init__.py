"""Column builders: vectors, scores of letters, statistics of a distribution."""
