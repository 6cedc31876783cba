"""Operators for preparing training data: archives, text extraction, token files,
decontamination, language-model scoring, packing, retrieval, near-duplicates,
URL filtering and toxicity.  Nothing else in the library imports this package."""
