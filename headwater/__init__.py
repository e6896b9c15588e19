"""Headwater: watershed analytics expressed as PySpark DataFrame jobs."""
