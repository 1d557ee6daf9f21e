"""Tessera: near-duplicate reduction of image tiles on PySpark."""
