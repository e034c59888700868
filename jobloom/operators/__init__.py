"""DataFrame operators. Each one takes DataFrames and returns DataFrames, lazily where it can."""
