"""Training-data pipeline operators: quality rules, mixing, near-duplicate and substring
removal, token output, sampling encoders, language and quality models, vector search and
URL filters. Nothing outside this subpackage imports it."""
