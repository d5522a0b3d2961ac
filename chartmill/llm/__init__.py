"""Training-data operators: filters, deduplication, language modelling, sharding, formatting and tokenisation.

Nothing outside this package imports it. Each module holds one operator with its own interface;
:mod:`chartmill.llm.queries` holds the thin queries over the synthetic tables.
"""
