"""Operators over collections, indexes and queries; each takes and returns DataFrames."""
