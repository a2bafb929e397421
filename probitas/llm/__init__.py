"""Training-data operators: near-duplicate removal, quality, scoring, tokenising, sharding, packing.

Nothing else in the library imports this subpackage. Every operator is a module with its own
general interface; :mod:`probitas.llm.queries` holds the registered queries over the given tables.
"""
