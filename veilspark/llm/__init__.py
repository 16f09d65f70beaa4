"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
names of columns, and returns DataFrames; the thin queries registered for the
driver live in :mod:`veilspark.llm.queries`.
"""
