"""Exact deduplication by Golomb-coded fingerprint exchange.

1. Rows become blocks of at most 65,536: ids, SHA-256 and 64-bit fingerprints,
   sorted by fingerprint, in one table of the shared folder (no texts).
2. Each block sends every owner (a range of the fingerprints) its sorted distinct
   fingerprints as one Golomb-Rice code: a few bytes each.
3. Owners answer each block with a bitmap: which of these occur elsewhere too.
   A text that fills a third of the rows comes once from each block.
4. Only rows marked in bitmaps, or repeated inside their block, are suspects. Their
   texts are shuffled, grouped by their bytes, copies of a text meeting map-side first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import exchange
from gridloom.llm.frames import attach, partition_id
from gridloom.session import ship, store

BLOCK_ROWS = 65_536
#: Fingerprints that an owner holds at once, on average.
OWNER_ROWS = 1 << 20
SPAN = 1 << 64
#: Suspect fingerprints (8 bytes, and a count) up to which they are broadcast; beyond, texts are shuffled by fingerprint, those of many copies over several tasks.
BROADCAST_FPS = 1_000_000


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, fp, sha) -> a row for each block."""
    held: list[pa.RecordBatch] = []
    count, block = 0, 0

    def out() -> pa.RecordBatch:
        nonlocal block
        table = pa.Table.from_batches(held).combine_chunks()
        table = table.take(pa.array(np.argsort(table["fp"].to_numpy().view(np.uint64), kind="stable")))
        src = (partition_id() << 24) + block
        block += 1
        lists = [pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table[c].combine_chunks()) for c in ("id", "fp", "sha")]
        return pa.RecordBatch.from_arrays([pa.array([src], pa.int64()), *lists], ["src", "ids", "fps", "shas"])

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, BLOCK_ROWS - count)
            held.append(part)
            count += part.num_rows
            at += part.num_rows
            if count == BLOCK_ROWS:
                yield out()
                held, count = [], 0
    if count:
        yield out()


def _owner_edges(values: np.ndarray, owner_bits: int) -> np.ndarray:
    """Where the sorted values of each owner begin."""
    starts = np.arange(1, 1 << owner_bits, dtype=np.uint64) << np.uint64(64 - owner_bits) if owner_bits else np.empty(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(values, starts), [len(values)]]).astype(np.int64)


def _coder(owner_bits: int):
    span = SPAN >> owner_bits

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for src, fps in zip(batch["src"].to_pylist(), batch["fps"], strict=True):
                values = np.unique(fps.values.to_numpy().view(np.uint64))
                edges = _owner_edges(values, owner_bits)
                for owner in np.flatnonzero(np.diff(edges)).tolist():
                    own = values[edges[owner] : edges[owner + 1]]
                    data, k = exchange.encode(own, owner * span, span)
                    rows.append((owner, src, len(own), k, data))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(
                    zip(*rows, strict=True) if rows else [[]] * 5,
                    (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()),
                    strict=True,
                )],
                ["owner", "src", "n", "k", "code"],
            )

    return code


def _answer(owner_bits: int):
    span = SPAN >> owner_bits

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        """An owner's lists -> for each list, a bitmap of the values that another list has too."""
        base = int(pdf["owner"].iloc[0]) * span
        lists = [exchange.decode(c, n, k, base) for c, n, k in zip(pdf["code"], pdf["n"], pdf["k"], strict=True)]
        values, where, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        twice = (counts > 1)[where]
        bits = np.split(twice, np.cumsum([len(x) for x in lists])[:-1])
        return pd.DataFrame({"src": pdf["src"], "owner": pdf["owner"], "bits": [np.packbits(b).tobytes() for b in bits]})

    return answer


def _flagger(owner_bits: int):
    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks with their bitmaps -> a row for each document."""
        for batch in batches:
            for i in range(batch.num_rows):
                src = batch["src"][i].as_py()
                fps = batch["fps"][i].values
                values, where, counts = np.unique(fps.to_numpy().view(np.uint64), return_inverse=True, return_counts=True)
                edges = _owner_edges(values, owner_bits)
                twice = counts > 1
                for answer in batch["bitmaps"][i].as_py() or []:
                    a, b = edges[answer["owner"]], edges[answer["owner"] + 1]
                    twice[a:b] |= np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=b - a).astype(bool)
                n = len(fps)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["ids"][i].values,
                        fps,
                        batch["shas"][i].values,
                        pa.array(twice[where]),
                        pa.array(np.full(n, src)),
                        pa.array(np.arange(n, dtype=np.int64)),
                    ],
                    ["id", "fp", "sha", "suspect", "src", "pos"],
                )

    return flag


def suspects(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored row for each document: id, fp, sha (32 bytes), suspect, and its place (src, pos)."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("fp"), F.unhex(F.sha2(text, 256)).alias("sha"))
    blocks = store(rows.mapInArrow(_blocks, "src long, ids array<long>, fps array<long>, shas array<binary>"), "fingerprints")
    total = blocks.agg(F.sum(F.size("fps"))).first()[0] or 0
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // OWNER_ROWS)
    bits = max(0, (owners - 1).bit_length())
    codes = blocks.select("src", "fps").mapInArrow(_coder(bits), "owner int, src long, n int, k int, code binary")
    bitmaps = codes.groupBy("owner").applyInPandas(_answer(bits), "src long, owner int, bits binary")
    bitmaps = bitmaps.groupBy("src").agg(F.collect_list(F.struct("owner", "bits")).alias("bitmaps"))
    flagged = blocks.join(bitmaps, "src", "left").mapInArrow(
        _flagger(bits),
        "id long, fp long, sha binary, suspect boolean, src long, pos long",
    )
    return store(flagged, "suspects")


def _copies(found: DataFrame) -> DataFrame:
    """fp, copies: how many rows are suspects by a fingerprint."""
    return found.groupBy("fp").agg(F.count(F.lit(1)).alias("copies"))


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts the row with the largest id stays; of
    rows with that id and the same text, one. A null id is smaller than any other.
    Other columns of ``docs`` are not read, whatever their names. An empty table
    gives an empty result.
    """
    rows = suspects(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = rows.where("suspect")
    texts = docs.select(text.alias("_text"), F.col(id_col).alias("_id")).withColumn("fp", F.xxhash64("_text"))
    texts = attach(texts, _copies(found), ["fp"], [F.col("_id")], "left_semi", "copies", BROADCAST_FPS)
    verified = texts.groupBy("_text").agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    verified = verified.select(F.xxhash64("_text").alias("fp"), F.unhex(F.sha2("_text", 256)).alias("sha"), "group_size")
    tops = found.groupBy("fp", "sha").agg(F.max(F.struct("id", "src", "pos")).alias("top"))
    groups = verified.join(tops, ["fp", "sha"])
    marked = attach(rows, groups, ["fp", "sha"], [F.col("src"), F.col("pos")], "left", "group_size")
    alone = F.col("top").isNull()
    return marked.select(
        F.col("id").alias("doc_id"),
        F.when(alone, F.col("id")).otherwise(F.col("top.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | ((F.col("top.src") == F.col("src")) & (F.col("top.pos") == F.col("pos")))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``mark_duplicates`` would drop; the same columns.

    Rows that aren't suspects pass as they are. Of the suspects, grouped by bytes,
    the row with the largest id stays (of several such rows any one). Null text counts as empty and
    stays null; a null id is smaller than any other. Other columns may have any names. An empty table stays
    empty.
    """
    names = docs.columns
    found = suspects(docs, id_col, text_col).where("suspect")
    text = F.coalesce(F.col(text_col), F.lit(""))
    others = [F.col(f"`{c}`") for c in names if c != text_col]
    rows = docs.select(
        text.alias("text"),
        F.col(text_col).isNull().alias("none"),
        F.col(id_col).alias("id"),
        F.struct(*others).alias("row"),
        F.xxhash64(text).alias("fp"),
    )
    rows = attach(rows, _copies(found), ["fp"], [F.col("id")], "left", "copies", BROADCAST_FPS)
    alone = rows.where("copies is null").select("text", "none", "row")
    rank = F.struct(F.col("id").isNotNull(), F.col("id"))
    best = rows.where("copies is not null").groupBy("text").agg(F.max_by(F.struct("none", "row"), rank).alias("best"))
    kept = alone.unionByName(best.select("text", "best.none", "best.row"))
    return kept.select(*[F.when(~F.col("none"), F.col("text")).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names])
