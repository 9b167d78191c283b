"""Byte n-gram and packet-payload analytics as Spark DataFrame transformations."""
