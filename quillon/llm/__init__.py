"""Training-data operators: packing, quality, toxicity, tokens, language models, archives, deduplication."""
