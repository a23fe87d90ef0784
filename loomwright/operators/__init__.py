"""Relational operators of entity resolution and search, over DataFrames."""
