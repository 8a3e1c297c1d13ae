"""Continuous ingest into a Store by Structured Streaming."""

from .ingest import ingest, replay

__all__ = ["ingest", "replay"]
