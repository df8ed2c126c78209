"""Requests: validation, operations, pipelines and recipes."""
