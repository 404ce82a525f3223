"""Table-to-table operators: every public function maps DataFrames to a DataFrame."""
