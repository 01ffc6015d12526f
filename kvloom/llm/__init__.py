"""Training-data operators: extraction, deduplication, search, quality, tokens and packing.

Nothing outside this subpackage imports it.  Operators take and return DataFrames; the thin
queries of :mod:`kvloom.llm.queries` bind them to the tables of a data folder.
"""
