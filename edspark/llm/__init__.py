"""Training-data operators: quality rules, toxicity, nearest neighbours,
language-model scoring, near-duplicate detection, chat formatting, language
identification, source mixing, sequence packing and sharding."""
