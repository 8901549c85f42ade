"""Incremental encoding of labelled files as they arrive (Structured Streaming)."""

from epiframe.streaming.encode_stream import encode_stream, start_encode_stream

__all__ = ["encode_stream", "start_encode_stream"]
