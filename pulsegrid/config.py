"""Settings of an engine: the grid of buckets, the limits on names and clients, the reserved prefix."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    #: Seconds of a bucket, and buckets of the longest window.
    bucket_s: int = 10
    buckets: int = 6
    #: How far ahead of the clock an event may be.
    future_ms: int = 10_000
    name_bytes: int = 256
    reserved_prefix: str = "pulsegrid."
    #: Names are dealt into shards by hash, each of which takes so many.
    shards: int = 32
    names_per_shard: int = 1024
    #: Names a client may create, and units of query work it may use, in each epoch.
    client_names: int = 64
    client_units: int = 50_000
    epoch_s: int = 10
    clients: int = 256
    #: Names that one unit of query work walks past.
    names_per_unit: int = 325
    max_limit: int = 1000
    max_body_bytes: int = 1 << 20
    max_event_bytes: int = 4 << 10
    max_batch_events: int = 10_000
    listed_errors: int = 10
    sketch_buckets: int = 1024
    #: Where rules are read from and generations are written to; empty: the default rules, and nowhere.
    rules_path: str = ""
    snapshot_path: str = ""

    @property
    def window_s(self) -> int:
        return self.bucket_s * self.buckets

    def with_total_names(self, total: int) -> Config:
        """The cap on all names, dealt evenly over the shards, rounded down."""
        if total < self.shards:
            raise ValueError(f"the cap on names must be at least {self.shards}")
        return replace(self, names_per_shard=total // self.shards)


def from_environment(environ: dict[str, str], base: Config | None = None) -> Config:
    """``PULSEGRID_MAX_NAMES`` sets the cap on names; anything but a whole number in range is an error.
    ``PULSEGRID_RULES`` and ``PULSEGRID_SNAPSHOT`` are paths."""
    base = replace(base or Config(), rules_path=environ.get("PULSEGRID_RULES", ""), snapshot_path=environ.get("PULSEGRID_SNAPSHOT", ""))
    text = environ.get("PULSEGRID_MAX_NAMES", "")
    if not text:
        return base
    try:
        return base.with_total_names(int(text))
    except ValueError as e:
        raise ValueError(f"PULSEGRID_MAX_NAMES {text!r}: {e}") from None


DEFAULT = Config()
