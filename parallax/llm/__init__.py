"""Training-data operators: one module per operator, `queries` binds them to tables.

Nothing outside this subpackage imports it.
"""
