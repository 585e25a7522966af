"""Pipelines over case tables, and the registered queries."""
