"""Quarry: source-tree and text intelligence expressed as Spark DataFrame jobs."""
