"""Operators that prepare text for language-model training.

Nothing else in the package imports this subpackage.  Every operator is a
function from DataFrames to a DataFrame; ``codicil.llm.queries`` applies each of
them to its whole table.
"""
