"""Operators on terminology tables; each takes and returns DataFrames."""
