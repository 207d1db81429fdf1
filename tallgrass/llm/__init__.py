"""Training-data operators: thirteen named operators and the queries that apply them.

Nothing outside this subpackage imports it.
"""
