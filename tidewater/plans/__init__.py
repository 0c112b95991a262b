"""Expressions, predicates, schemas and the runner of declared pipelines."""
