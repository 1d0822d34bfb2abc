"""Removal of long word passages that an earlier document holds, by suffix automata.

1. Routing. Every window of ``window`` words names an anchor: the smallest hash of the
   ``GRAM``-word sequences in it. Equal windows have equal anchors, so only windows whose
   anchor occurs in several documents can repeat. Of these, equal hashes find for each
   window the earliest document that holds it.
2. Reference shards. The passages of those earlier documents, cut into shards of bounded
   size, become suffix automata whose states know the smallest document they occur in.
3. Matching statistics. The passages of later documents stream through the automaton of
   their shard; wherever the longest match with a smaller document spans the window, its
   words are marked. Marks join to maximal spans.

Shards go where their readers meet, with as many copies as their readers fill tasks, and
not to every task: all documents through all shards would be quadratic work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import words as W
from gridloom.llm.frames import as_bytes, attach, partition_id, pieces, small
from gridloom.session import ship, store

WINDOW, GRAM = 50, 20
#: Words of a reference shard, and of the readers of one copy of it.
SHARD_WORDS, READER_WORDS = 100_000, 1_000_000
#: Windows that a task gathers before it sends them.
GATHER = 1 << 21
BROADCAST_IDS = 1_000_000
#: Odd bases of the two rolling hashes.
_BASE_1, _BASE_2 = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1


class Rolling:
    """Hashes of all runs of consecutive words by prefix sums modulo 2**64."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) <= n:
            size = 1 << int(n).bit_length()
            self.up = self._powers(self.base, size)
            self.down = self._powers(self.inverse, size)

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        out = np.full(size + 1, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def runs(self, h: np.ndarray, size: int) -> np.ndarray:
        n = len(h)
        self.reach(n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.up[:n], dtype=np.uint64)])
        return W.mix((sums[size:] - sums[:-size]) * self.down[: n - size + 1])


_one, _two = Rolling(_BASE_1), Rolling(_BASE_2)


def anchors(h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The anchor of each window: the smallest hash of a gram in it."""
    low = _one.runs(h, gram)
    need, have = window - gram + 1, 1
    while have * 2 <= need:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[: len(low) - (need - have)], low[need - have :]) if need > have else low


class Automaton:
    """A suffix automaton over several word sequences; states know their smallest document."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.low = [-1], [0], [1 << 63]

    def add(self, words: list[int], doc: int) -> None:
        nxt, link, size, low = self.next, self.link, self.size, self.low
        last = 0
        for word in words:
            if (to := nxt[last].get(word)) is not None:
                if size[to] == size[last] + 1:
                    last = to
                    if doc < low[to]:
                        low[to] = doc
                    continue
                copy = len(nxt)
                nxt.append(dict(nxt[to]))
                link.append(link[to])
                size.append(size[last] + 1)
                low.append(min(doc, low[to]))
                p = last
                while p >= 0 and nxt[p].get(word) == to:
                    nxt[p][word] = copy
                    p = link[p]
                link[to] = copy
                last = copy
                continue
            new = len(nxt)
            nxt.append({})
            link.append(0)
            size.append(size[last] + 1)
            low.append(doc)
            p = last
            while p >= 0 and word not in nxt[p]:
                nxt[p][word] = new
                p = link[p]
            if p >= 0:
                to = nxt[p][word]
                if size[to] == size[p] + 1:
                    link[new] = to
                else:
                    copy = len(nxt)
                    nxt.append(dict(nxt[to]))
                    link.append(link[to])
                    size.append(size[p] + 1)
                    low.append(low[to])
                    while p >= 0 and nxt[p].get(word) == to:
                        nxt[p][word] = copy
                        p = link[p]
                    link[to] = link[new] = copy
            last = new

    def finish(self) -> None:
        """A state's smallest document is also one of its suffixes' documents."""
        for state in sorted(range(1, len(self.next)), key=self.size.__getitem__, reverse=True):
            up = self.link[state]
            if self.low[state] < self.low[up]:
                self.low[up] = self.low[state]

    def spans(self, words: list[int], doc: int, window: int) -> list[tuple[int, int]]:
        """Maximal spans covered by matches of ``window`` words with a smaller document."""
        nxt, link, size, low = self.next, self.link, self.size, self.low
        state = length = 0
        out: list[tuple[int, int]] = []
        for end, word in enumerate(words, 1):
            while state and word not in nxt[state]:
                state = link[state]
                length = size[state]
            to = nxt[state].get(word)
            if to is None:
                state = length = 0
                continue
            state, length = to, length + 1
            while state and low[state] >= doc:  # no smaller document holds this much
                state = link[state]
                length = min(length, size[state])
            if length >= window:
                if out and out[-1][1] >= end - window:
                    out[-1] = (out[-1][0], end)
                else:
                    out.append((end - window, end))
        return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)],
        names,
    )


def _base(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents -> word count, SHA-256 of all words joined by a space, distinct anchors."""
        for batch in pieces(batches, 512):
            rows = []
            for key, text in zip(batch["id"].to_pylist(), as_bytes(batch["text"]), strict=True):
                words = (text or b"").split()
                found = np.unique(anchors(W.hashed(words), window, gram)) if len(words) >= window and key is not None else np.empty(0, np.uint64)
                rows.append((key, len(words), hashlib.sha256(b" ".join(words)).digest(), W.signed(found)))
            yield _table(rows, ["id", "n_words", "sha", "anchors"], [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())])

    return run


_HIT = ["doc", "start", "count", "owner", "owner_start"]


def _runs(doc: np.ndarray, start: np.ndarray, owner: np.ndarray, owner_start: np.ndarray) -> list[np.ndarray]:
    """Windows sorted by (doc, start) -> runs of consecutive windows with consecutive owners."""
    new = np.concatenate([
        [True],
        (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (owner[1:] != owner[:-1]) | (owner_start[1:] != owner_start[:-1] + 1),
    ])
    at = np.flatnonzero(new)
    return [doc[at], start[at], np.diff(np.append(at, len(doc))), owner[at], owner_start[at]]


def _windows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with their repeated anchors -> windows (count 0) to be compared, and runs.

        Of equal windows in a task only the earliest document's go out; for the others this
        document is already an earlier one, so they are runs (count above 0) under a key of
        their own.
        """
        held: list[list[np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            k1, k2, doc, start = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((start, doc, k2, k1))
            k1, k2, doc, start = k1[order], k2[order], doc[order], start[order]
            new = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = doc > doc[head]
            zeros = np.zeros(int((~later).sum()), np.int64)
            columns = [W.signed(k1[~later]), k2[~later], doc[~later], start[~later], zeros, zeros, zeros]
            if later.any():
                d, s, o, p = doc[later], start[later], doc[head][later], start[head][later]
                order = np.lexsort((s, d))
                d, s, n, o, p = _runs(d[order], s[order], o[order], p[order])
                key = W.signed(W.mix(d.view(np.uint64) * W.GOLDEN + s.view(np.uint64)))
                columns = [np.concatenate(c) for c in zip(columns, [key, np.zeros(len(d), np.int64), d, s, n, o, p], strict=True)]
            for at in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in columns], ["k1", "k2", *_HIT])

        for batch in pieces(batches, 256):
            for i, (key, text) in enumerate(zip(batch["id"].to_pylist(), as_bytes(batch["text"]), strict=True)):
                h = W.hashed((text or b"").split())
                wanted = np.sort(batch["anchors"][i].values.to_numpy().view(np.uint64))
                own = anchors(h, window, gram)
                at = np.searchsorted(wanted, own)
                at[at == len(wanted)] = 0
                start = np.flatnonzero(wanted[at] == own)
                second = _two.runs(W.mix(h), window)[start] >> np.uint64(32)
                held.append([_one.runs(h, window)[start], second.astype(np.int64), np.full(len(start), key, np.int64), start])
                size += len(start)
                if size >= GATHER:
                    yield from out()
                    held, size = [], 0
        if size:
            yield from out()

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows sorted by (k1, k2, doc, start) -> those that an earlier document has, with it; runs as they came."""
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2, *rest = (batch[c].to_numpy() for c in ("k1", "k2", *_HIT))
        ready = rest[2] > 0
        parts = [[c[ready] for c in rest]]
        k1, k2 = k1[~ready], k2[~ready]
        doc, start = rest[0][~ready], rest[1][~ready]
        if len(k1):
            if last is not None:
                k1, k2, doc, start = (np.concatenate([np.array([x], c.dtype), c]) for x, c in zip(last, (k1, k2, doc, start), strict=True))
            new = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            last = tuple(c[head[-1]] for c in (k1, k2, doc, start))
            later = doc > doc[head]
            parts.append([doc[later], start[later], np.ones(int(later.sum()), np.int64), doc[head][later], start[head][later]])
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _HIT)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by (doc, start) -> longer runs where they follow each other."""
    last: list | None = None
    for batch in batches:
        rows = []
        for doc, start, count, owner, owner_start in zip(*(batch[c].to_pylist() for c in _HIT), strict=True):
            if last and last[0] == doc and last[3] == owner and last[1] <= start <= last[1] + last[2] and start - last[1] == owner_start - last[4]:
                last[2] = max(last[2], start - last[1] + count)
                continue
            if last:
                rows.append(tuple(last))
            last = [doc, start, count, owner, owner_start]
        if rows:
            yield _table(rows, _HIT, [pa.int64()] * 5)
    if last:
        yield _table([tuple(last)], _HIT, [pa.int64()] * 5)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the segments that shards want -> a row of word hashes for each."""
    for batch in pieces(batches, 32):
        rows, size = [], 0
        for i, (key, text) in enumerate(zip(batch["id"].to_pylist(), as_bytes(batch["text"]), strict=True)):
            h = W.signed(W.hashed((text or b"").split()))
            wanted: dict[tuple, list[tuple[int, int]]] = {}
            for x in batch["segments"][i].as_py():
                wanted.setdefault((x["shard"], x["copy"], x["reads"]), []).append((x["start"], x["stop"]))
            for place, spans in wanted.items():
                for a, b in _merged(spans):
                    rows.append((*place, key, a, h[a:b]))
                    size += b - a
            if size > 1 << 20:
                yield _table(
                    rows,
                    ["shard", "copy", "reads", "doc", "start", "words"],
                    [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())],
                )
                rows, size = [], 0
        if rows:
            yield _table(
                rows,
                ["shard", "copy", "reads", "doc", "start", "words"],
                [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())],
            )


def _match(window: int):
    def run(table: pa.Table) -> pa.Table:
        """A copy of a shard and its readers -> the readers' spans."""
        automaton, rows = Automaton(), []
        reads, doc, start = (table[c].to_pylist() for c in ("reads", "doc", "start"))
        words = table["words"].combine_chunks()
        for i in sorted((i for i, r in enumerate(reads) if not r), key=doc.__getitem__):
            automaton.add(words[i].as_py(), doc[i])
        automaton.finish()
        for i, r in enumerate(reads):
            if r:
                rows += [(doc[i], start[i] + a, start[i] + b) for a, b in automaton.spans(words[i].as_py(), doc[i], window)]
        return pa.Table.from_batches([_table(rows, ["doc", "start", "stop"], [pa.int64()] * 3)])

    return run


def _stored(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows, store(rows.mapInArrow(_base(window, gram), "id long, n_words long, sha binary, anchors array<long>"), "anchors")


def _spans(rows: DataFrame, base: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(the documents that may have spans; doc, start, stop)."""
    clean = base.where(F.size("anchors") > 0)
    mixed = clean.groupBy("id").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).where("a <> b").select("id")
    named = clean.join(mixed, "id", "left_anti").select("id", F.explode("anchors").alias("anchor"))
    repeated = named.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b")
    # A passage that very many documents share has as many rows of its anchors.
    shared = attach(named, repeated.select("anchor", "n"), ["anchor"], [F.col("id")], "left_semi", "n")
    wanted = store(shared.groupBy("id").agg(F.collect_set("anchor").alias("anchors")), "wanted")
    some = rows.join(small(wanted.select("id"), "candidates", BROADCAST_IDS), "id", "left_semi").dropDuplicates(["id"])
    texts = store(some.join(wanted, "id"), "candidate-texts")
    sent = texts.mapInArrow(_windows(window, gram), "k1 long, k2 long, doc long, start long, count long, owner long, owner_start long")
    hits = sent.repartition("k1").sortWithinPartitions("k1", "k2", "doc", "start").mapInArrow(
        _compare,
        "doc long, start long, count long, owner long, owner_start long",
    )
    runs = store(
        hits.repartition("doc").sortWithinPartitions("doc", "start", "owner").mapInArrow(
            _joined,
            "doc long, start long, count long, owner long, owner_start long",
        ),
        "runs",
    )
    stop = lambda start: F.col(start) + F.col("count") + (window - 1)
    owned = runs.select(F.col("owner").alias("id"), F.col("owner_start").alias("start"), stop("owner_start").alias("stop")).distinct()
    # A document's share of the reference is at most its own words; a shard takes documents up to its size.
    load = owned.groupBy("id").agg((F.max("stop") - F.min("start")).alias("words"))
    total = load.agg(F.sum("words")).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(shards))
    readers = runs.select(F.col("doc").alias("id"), F.col("start"), stop("start").alias("stop"), shard("owner").alias("shard"))
    copies = readers.groupBy("shard").agg(F.sum(F.col("stop") - F.col("start")).alias("words"))
    copies = store(copies.select("shard", F.ceil(F.col("words") / READER_WORDS).cast("int").alias("copies")), "copies")
    if copies.count() <= BROADCAST_IDS:
        copies = F.broadcast(copies)
    reading = readers.join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64("id"), F.col("copies")).cast("int"))
    held = owned.withColumn("shard", shard("id")).join(copies, "shard").withColumn(
        "copy",
        F.explode(F.sequence(F.lit(0), F.col("copies") - 1)),
    )
    segment = lambda reads: F.struct("shard", "copy", F.lit(reads).alias("reads"), "start", "stop")
    segments = reading.select("id", segment(True).alias("segment")).unionAll(held.select("id", segment(False).alias("segment")))
    segments = segments.groupBy("id").agg(F.collect_list("segment").alias("segments"))
    cut = texts.select("id", "text").join(segments, "id").mapInArrow(
        _extract,
        "shard long, copy int, reads boolean, doc long, start long, words array<long>",
    )
    found = cut.groupBy("shard", "copy").applyInArrow(_match(window), "doc long, start long, stop long")
    return texts, store(found, "spans")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc, start, stop: the words to remove, as spans that may touch or overlap."""
    ship(docs.sparkSession)
    rows, base = _stored(docs, id_col, text_col, window, gram)
    return _spans(rows, base, window, gram)[1]


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 256):
        rows = []
        for i, (key, text) in enumerate(zip(batch["id"].to_pylist(), as_bytes(batch["text"]), strict=True)):
            words = (text or b"").split()
            gone = np.zeros(len(words), bool)
            for x in batch["spans"][i].as_py():
                gone[x["start"] : x["stop"]] = True
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            rows.append((key, int(gone.sum()), kept.decode("utf-8", "replace"), hashlib.sha256(kept).digest()))
        yield _table(rows, ["id", "n_removed", "kept_text", "kept_sha"], [pa.int64(), pa.int64(), pa.string(), pa.binary()])


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    with_text: bool = True,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and kept_text if asked for.

    A word goes if a window of ``window`` consecutive words over it also occurs in a document with a
    smaller id; windows are judged on the input. Words lie between ASCII white space and
    are compared unchanged; kept words are joined by one space. kept_text is null where nothing was
    removed. Null and empty texts have no words. A row without id, and rows that repeat an
    id with different texts, keep all words and count for no one; rows that repeat an id with
    the same text get the same result. Other columns are not read. An empty table gives no
    rows.
    """
    ship(docs.sparkSession)
    rows, base = _stored(docs, id_col, text_col, window, gram)
    texts, found = _spans(rows, base, window, gram)
    lists = found.groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    changed = texts.select("id", "text").join(lists, "id").mapInArrow(_keep, "id long, n_removed long, kept_text string, kept_sha binary")
    changed = changed if with_text else changed.drop("kept_text")
    out = base.drop("anchors").join(changed, "id", "left")
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.lower(F.hex(F.coalesce("kept_sha", "sha"))).alias("kept_sha256"),
        *([F.col("kept_text")] if with_text else []),
    )
