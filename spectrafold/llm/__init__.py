"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own general interface and a thin ``opN_*`` query over the driver's
tables; :mod:`spectrafold.llm.catalog` lists the queries.
"""
