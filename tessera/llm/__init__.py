"""Operations of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; ``llm.queries`` derives the contract
columns of the registered queries from them.
"""
