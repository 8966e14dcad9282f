"""Corpus preparation for language-model training: ten operators, each usable alone."""
