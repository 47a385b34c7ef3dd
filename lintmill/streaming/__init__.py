"""Incremental maintenance of corpus tables."""
