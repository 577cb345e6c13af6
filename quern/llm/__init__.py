"""Training-data operators: one module for each operator, plus the queries that apply them.

Nothing outside this subpackage imports it; it imports nothing from the rest of the library.
"""
