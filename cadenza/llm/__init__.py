"""Training-data operators: licence, secret and benchmark scans, language-model
scoring, quality, near-duplicates, sharding, tokenising and chat formatting.
Nothing outside this package imports it."""
