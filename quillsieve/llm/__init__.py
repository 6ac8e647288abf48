"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Each operator module keeps a
general interface (column names and parameters); ``queries`` binds the
operators to the tables of the driver contract.
"""
