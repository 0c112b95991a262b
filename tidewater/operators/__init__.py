"""Transforms on DataFrames: select, aggregate, windows, routing, change data, attribution."""
