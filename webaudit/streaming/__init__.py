"""The incremental side of the engine as Structured Streaming jobs."""

from .jobs import (
    CAPTURE_DELAY, crawl_sessions, final_captures, heartbeat, latest, new_probe_urls, page_findings,
    per_batch, probe_batches, probe_findings, strike_batches, upsert_batches,
)
from .runner import read_stream, run_available

__all__ = [
    "CAPTURE_DELAY", "crawl_sessions", "final_captures", "heartbeat", "latest", "new_probe_urls",
    "page_findings", "per_batch", "probe_batches", "probe_findings", "read_stream", "run_available",
    "strike_batches", "upsert_batches",
]
