"""Operations of a large-scale training-data pipeline, one module for each operator.

Nothing outside this folder imports it; ``tracewell.llm.queries`` holds its registered queries.
"""
