"""Training-data operators for corpora far larger than one machine.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the ``op*`` queries in :mod:`docloom.llm.queries` are thin wrappers.
"""
