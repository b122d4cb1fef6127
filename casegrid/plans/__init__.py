"""Batch jobs: each reads tables, composes operators and publishes a new version."""
