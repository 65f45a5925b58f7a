"""Retrieval, graph and corpus operators as DataFrame plans."""
