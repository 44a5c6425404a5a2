"""Training-data operators: the corpus operators and the queries that run them.

Each module holds one operator with its own general interface (DataFrames in,
DataFrames out). `queries` derives the registered `opN_<name>` results from
them; `sql` holds the DuckDB twins of those that SQL can express. Nothing
outside this subpackage imports it, except the guarded registration in the
driver entry module.
"""
