"""Row shapes, fixed parameters and the command-line configuration."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import types as T

import kvlume

# Executors get the package's functions inside the task.
cloudpickle.register_pickle_by_value(kvlume)

SEGMENTS = 32
NODES = 5
LEVELS = 4
#: Bytes that an entry costs in a memtable besides its key and value.
ENTRY_OVERHEAD = 32
FLUSH_BYTES = 4 * 1024 * 1024
#: Bytes of a log frame besides key and value: checksum, length, type, sequence
#: and the two string lengths.
FRAME_OVERHEAD = 25
WRITE_BACK_BATCH = 5_000
TELEMETRY_RING = 1_024
TRAIN_BATCH = 64
TRAIN_MINIMUM = 8
EVENT_RING = 50
APPEND_LIMIT = 200
RETAINED_ENTRIES = 1_000
MAX_RATE = 12_000
MAX_FRAME = 64 * 1024 * 1024

KV_LOG = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("key", T.StringType()),
    T.StructField("op", T.StringType()),
    T.StructField("value", T.StringType()),
])
RAFT_LOG = T.StructType([T.StructField("term", T.LongType()), T.StructField("index", T.LongType()), T.StructField("command", T.StringType())])


@dataclass(frozen=True)
class Config:
    """What the server takes as flags; the cluster always has five nodes."""

    port: int = 6379
    http_port: int = 8080
    capacity: int = 65_536
    mode: str = "write-through"
    flush_interval: int = 5
    data_dir: str = "data"
    node_id: int = 0
    cluster_size: int = NODES

    @property
    def segment_capacity(self) -> int:
        return segment_capacity(self.capacity)


def segment_capacity(total: int, segments: int = SEGMENTS) -> int:
    """An equal whole share for each segment, and one entry at least."""
    return max(1, total // segments)


def parse_args(argv: list[str]) -> Config:
    p = argparse.ArgumentParser(prog="kvlume")
    base = Config()
    for name in ("port", "http-port", "capacity", "flush-interval", "node-id", "cluster-size"):
        p.add_argument(f"--{name}", type=int, default=getattr(base, name.replace("-", "_")))
    p.add_argument("--mode", choices=("write-through", "write-back"), default=base.mode)
    p.add_argument("--data-dir", default=base.data_dir)
    return Config(**vars(p.parse_args(argv)))
