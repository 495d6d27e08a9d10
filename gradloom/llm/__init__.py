"""Training-data operators: quality, privacy, search, language, deduplication, language models, mixing, tokens.

Every operator takes and returns DataFrames.  Nothing outside this subpackage imports it.
"""
