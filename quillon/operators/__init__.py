"""Retrieval, catalogue, chunking, layout, verification and evaluation operators."""
