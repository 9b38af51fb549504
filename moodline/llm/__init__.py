"""Operators of a training-data pipeline (language ID, dedup, quality, PII,
tokens, packing, sharding, licences). Nothing else in the library imports this
subpackage; ``moodline.llm.queries`` lists its registered queries."""
