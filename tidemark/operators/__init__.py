"""Relational operators of the engine. All take and return DataFrames and an explicit as_of."""
