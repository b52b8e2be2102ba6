"""Batch credit-risk feature analytics expressed as Spark DataFrame plans."""
