"""Loamline: document collections, chunks and retrieval as Spark DataFrame plans."""
