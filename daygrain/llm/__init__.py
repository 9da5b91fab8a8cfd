"""Training-data operators: quality, near-duplicates, language, packing, LM scores, mixing, records, fingerprints, secrets, embeddings."""
