"""Operators on tables of findings, graphs, evidence and metrics."""
