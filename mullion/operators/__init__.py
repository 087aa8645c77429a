"""Operators on DataFrames; none of them knows a table of the queries."""
