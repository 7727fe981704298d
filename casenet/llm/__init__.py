"""Training-data operators: quality, toxicity, tokens, deduplication, packing, chat.

Nothing outside this subpackage imports it.
"""
