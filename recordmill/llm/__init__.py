"""Operators for preparing a text corpus: deduplication, filtering, scoring, tokens and vectors."""
