"""Training-data operators: ten corpus operators over plain DataFrames.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries and their SQL.
"""
