"""Training-data operators: quality, toxicity, duplicates, search, mixing, packing, sharding, token counts, URL rules.

Nothing else in the library imports this subpackage; its queries and their SQL are in ``quern.llm.queries``.
"""
