"""Table-at-a-time operators: every function takes and returns DataFrames."""
