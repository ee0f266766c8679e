"""Incremental ingest with Structured Streaming."""

from .ingest import stream_ingest, validated_stream

__all__ = ["stream_ingest", "validated_stream"]
