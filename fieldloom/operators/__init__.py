"""DataFrame operators of the grid engine; each takes and returns DataFrames."""
