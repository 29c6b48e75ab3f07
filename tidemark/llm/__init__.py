"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Every operator takes DataFrames, names the
columns it reads, ignores all others and returns an id plus its own result columns, so
extra columns of the input can never clash with what it adds.
"""
