"""Training-data operators: one module per operator, plus shared helpers.

Nothing outside this subpackage imports it.  ``registry`` lists the queries and
their DuckDB SQL.
"""
