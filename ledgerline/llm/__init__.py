"""Operators and a pipeline for training corpora: tokenising, scoring, de-duplication, search, redaction and packing."""
