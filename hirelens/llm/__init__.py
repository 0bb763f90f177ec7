"""Training-data operators: quality, packing, near-duplicates, toxicity, personal data,
vector search, line dedup, source mixing, quality rules, page extraction."""
