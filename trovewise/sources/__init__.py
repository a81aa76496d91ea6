"""Readers of collections, topics and tables, and writers of indexes and runs."""
