"""Schemas, constants, options and errors of the versioned key-value model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Fixed values of the model.
PUT, DELETE = 0, 1
MAX_SEQ = 2**63 - 1
NUM_LEVELS = 7
L0_TRIGGER = 4
L0_STOP = 12
TARGET_FILE_BYTES = 2 * 1024 * 1024
LEVEL_BASE_BYTES = 10 * 1024 * 1024
LEVEL_FACTOR = 10
GRANDPARENT_LIMIT = 20 * 1024 * 1024
LOG_BLOCK = 32768
LOG_HEADER = 7
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4
RESTART_INTERVAL = 16
DATA_BLOCK_BYTES = 4096
COMPARATOR = "bytewise"

MUTATIONS = T.StructType(
    [
        T.StructField("user_key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("vtype", T.ByteType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)
RUNS = T.StructType([T.StructField("run_no", T.LongType(), False), *MUTATIONS.fields])
BOUND = T.StructType([T.StructField("user_key", T.BinaryType()), T.StructField("seq", T.LongType()), T.StructField("vtype", T.ByteType())])
META = [
    T.StructField("number", T.LongType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("smallest", BOUND),
    T.StructField("largest", BOUND),
    T.StructField("allowed_seeks", T.LongType()),
]
FILES = T.StructType([T.StructField("level", T.IntegerType()), *META])
EDITS = T.StructType(
    [
        T.StructField("edit_no", T.LongType()),
        T.StructField("comparator", T.StringType()),
        T.StructField("log_number", T.LongType()),
        T.StructField("prev_log_number", T.LongType()),
        T.StructField("next_file_number", T.LongType()),
        T.StructField("last_sequence", T.LongType()),
        T.StructField("deleted_files", T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("number", T.LongType())]))),
        T.StructField("new_files", T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("meta", T.StructType(META))]))),
        T.StructField("compact_pointers", T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("user_key", T.BinaryType())]))),
    ]
)
WAL_PIECES = T.StructType(
    [
        T.StructField("pos", T.LongType()),
        T.StructField("rtype", T.ByteType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("crc_ok", T.BooleanType()),
        T.StructField("data", T.BinaryType()),
    ]
)
SNAPSHOTS = T.StructType([T.StructField("handle_id", T.LongType()), T.StructField("seq", T.LongType())])


@dataclass(frozen=True)
class Options:
    """Only the two flush bounds and the compaction switch change results; the rest is for the writer."""

    memtable_flush_entries: int = 1000
    memtable_max_bytes: int = 4 * 1024 * 1024
    block_size: int = 4096
    bloom_bits_per_key: int = 10
    table_cache_size: int = 100
    sync_writes: bool = True
    disable_auto_compaction: bool = False


class StoreError(Exception):
    """Base of all errors of the store."""


class NotFound(StoreError):
    pass


class InvalidArgument(StoreError):
    pass


class Corrupted(StoreError):
    pass


class NotSupported(StoreError):
    pass
