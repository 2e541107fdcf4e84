"""Training-data operators: toxicity, quality, token files, near and exact duplicates, personal data, mixing,
language-model scoring and BPE coding. Nothing outside this package and ``corpus_pipeline`` imports it."""
