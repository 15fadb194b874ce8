"""Linked-marker graph analytics expressed as Spark DataFrame plans."""
