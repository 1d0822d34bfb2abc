"""Small helpers for the DataFrames of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import threading
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import store

#: Members beyond which a group is dealt over several tasks, and how many groups may be so at most.
HOT_ROWS, HOT_KEYS = 2048, 1_000_000


#: Seconds without use after which a worker forgets its words; idle workers live on for a minute or more.
FORGET_AFTER = 4.0
_clear: dict[str, Callable[[], None]] = {}
_lock = threading.RLock()
_state = {"used": 0.0, "keeper": None}


def _give_back() -> None:
    """Let this process return freed memory at once: several workers wait idle on an executor, each with what it once needed."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        for option in (-3, -1):  # M_MMAP_THRESHOLD and M_TRIM_THRESHOLD, which otherwise rise by themselves
            ctypes.CDLL(None).mallopt(option, 1 << 20)


_give_back()


def _trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def _forget() -> None:
    for name in list(_clear):
        _clear.pop(name)()
    _trim()


def _keep() -> None:
    while True:
        time.sleep(1)
        with _lock:
            if _clear and time.monotonic() - _state["used"] > FORGET_AFTER:
                _forget()


@contextlib.contextmanager
def memory(name: str, clear: Callable[[], None]) -> Iterator[None]:
    """Use what this worker remembers for an operator; what it remembers for others is cleared.

    Workers outlive stages, and several wait idle on an executor, so what each remembers would
    add up. ``clear`` is called when another operator begins, or when nothing was used for a while.
    """
    with _lock:
        if name not in _clear:
            _forget()
            _clear[name] = clear
            if _state["keeper"] is None:
                _state["keeper"] = threading.Thread(target=_keep, daemon=True)
                _state["keeper"].start()
        yield
        _state["used"] = time.monotonic()


def partition_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def pieces(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that long texts don't add up."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def as_batches(schema: str, rows: Iterator[tuple], size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most 2,000 rows, or of 4 MB by ``size`` and what the last row adds."""
    named = [x.split() for x in schema.split(", ")]
    kinds = [pa.list_(_ARROW[kind[6:-1]]) if kind.startswith("array<") else _ARROW[kind] for _, kind in named]
    names = [name for name, _ in named]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    held, much = [], 0
    for row in rows:
        held.append(row)
        much += size(row)
        if len(held) >= 2000 or much > 1 << 22:
            yield batch()
            held, much = [], 0
    if held:
        yield batch()


def attach(left: DataFrame, right: DataFrame, keys: list[str], spread: list[Column], how: str, rows: str, broadcast: int = 0) -> DataFrame:
    """Join facts of groups to the members of groups, the members of a large group dealt over several tasks.

    ``right`` holds one row for each key; its column ``rows`` tells how many members a group has.
    A group of more than HOT_ROWS is dealt over as many parts as that goes into it, and only its
    facts are copied. The table of such groups is broadcast: if there are very many members, HOT_ROWS
    rises so that no more than HOT_KEYS groups can be large. ``spread``: what tells the members
    of a group apart. Facts of up to ``broadcast`` groups are broadcast as a whole.
    """
    right = store(right, "facts")
    groups, members = right.agg(F.count(F.lit(1)), F.sum(rows)).first()
    if groups <= broadcast:
        return left.join(F.broadcast(right), keys, how)
    limit = max(HOT_ROWS, (members or 0) // HOT_KEYS)
    hot = right.where(F.col(rows) > limit).select(*keys, F.ceil(F.col(rows) / limit).cast("int").alias("_parts"))
    if hot.isEmpty():
        return left.join(right, keys, how)
    hot = F.broadcast(store(hot, "hot"))
    part = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_parts")).cast("int"), F.lit(0))
    left = left.join(hot, keys, "left").withColumn("_part", part).drop("_parts")
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    right = right.join(hot, keys, "left").withColumn("_part", F.explode(copies)).drop("_parts")
    return left.join(right, [*keys, "_part"], how).drop("_part")


def small(df: DataFrame, label: str, rows: int) -> DataFrame:
    """``df`` stored; to be broadcast if it has at most ``rows`` rows, else joined as Spark sees fit."""
    kept = store(df, label)
    return F.broadcast(kept) if kept.count() <= rows else kept
