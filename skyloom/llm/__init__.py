"""Corpus and record-linkage operators; nothing outside this package imports it."""
