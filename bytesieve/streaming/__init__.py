"""Structured Streaming jobs: folder ingest, sightings, packets, flow messages."""
