"""User-visible options."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TrackOptions:
    """Limits are in bytes, times in seconds.

    `tx_timeout` counts from the first record of a request, not from the last one seen. A worker is started anew
    `thread_restarts` times at most, without end at 0; then it is abandoned.
    """

    max_reclen: int = 1024
    maxkeylen: int = 128
    chunk_size: int = 256
    tx_timeout: float = 120.0
    tx_limit: int = 1000
    monitor_interval: int = 30
    thread_restarts: int = 1
    log_error_data: bool = False
    topic: str | None = None
    num_partitions: int = 4

    def __post_init__(self) -> None:
        for name, least in (("max_reclen", 1), ("maxkeylen", 1), ("chunk_size", 64), ("tx_timeout", 0), ("tx_limit", 1), ("monitor_interval", 1), ("thread_restarts", 0), ("num_partitions", 1)):
            if getattr(self, name) < least:
                raise ValueError(f"{name} must be at least {least}")

    @classmethod
    def of(cls, **values) -> TrackOptions:
        """Options from names and values, e.g. of a parsed file; unknown names are an error."""
        unknown = sorted(set(values) - set(cls.__dataclass_fields__))
        if unknown:
            raise ValueError(f"unknown option: {', '.join(unknown)}")
        return cls(**values)
