"""Training-data pipeline operators: deduplication, quality, toxicity, licences, tokens, mixing."""
