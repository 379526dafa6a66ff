"""The queue worker as a Structured Streaming query."""

from .worker import Worker, claim_state_stream, enqueue, fold_status_files

__all__ = ["Worker", "claim_state_stream", "enqueue", "fold_status_files"]
