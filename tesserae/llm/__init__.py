"""Operators for training-data corpora: deduplication, decontamination, tokens, language and licences."""
