"""Column expressions: codecs, hashes, packet headers, HTTP heads, sizing formulas."""
