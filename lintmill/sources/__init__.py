"""Readers of analyzer output and source trees, and writers of reports."""
