from siteops.streaming.batches import ReplayBatches
from siteops.streaming.fanout import FanOut, Snapshots, fan_out, parquet_sink, run_to_parquet
from siteops.streaming.interaction import (
    changes_stream,
    hover_stream,
    not_found_sketches,
    not_found_stream,
    not_found_windows,
    sessions_stream,
    toggle_stream,
    top_not_found,
    ttl_stream,
)
from siteops.streaming.numbering import NumberedBatches
from siteops.streaming.ordered import Ordered, in_order
from siteops.streaming.replay import replay_stream

__all__ = [
    "FanOut",
    "NumberedBatches",
    "Ordered",
    "ReplayBatches",
    "Snapshots",
    "changes_stream",
    "fan_out",
    "hover_stream",
    "in_order",
    "not_found_sketches",
    "not_found_stream",
    "not_found_windows",
    "parquet_sink",
    "replay_stream",
    "run_to_parquet",
    "sessions_stream",
    "toggle_stream",
    "top_not_found",
    "ttl_stream",
]
