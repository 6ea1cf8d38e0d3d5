"""quillon: a Spark-first engine for literature retrieval, evidence and evaluation."""

__all__ = ["session"]
