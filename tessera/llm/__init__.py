"""Training-data operators: quality, dedup, decontamination, privacy, tokens.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it can be imported.
"""
