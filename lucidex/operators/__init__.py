"""Relational operators over documents, chunks, graphs, runs and scores."""
