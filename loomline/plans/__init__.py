"""Pipelines, registered queries and their SQL."""
