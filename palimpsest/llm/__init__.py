"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Its queries are in
:mod:`palimpsest.llm.queries`.
"""
