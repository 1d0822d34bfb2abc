"""How sources of one language differ from each other: an audit by joint count histograms.

Every (language, source) group smooths its term counts over the terms of its language. A pair of
groups is compared term by term, but a term's share depends only on its two counts, so terms are tallied by the pair
of counts first: a joint histogram. Cells with a zero are never listed term by term: they are what a group's own
histogram has left. The divergence is then worked out once for each cell, in whole numbers, times its terms.

Terms pass between tasks in blocks of many, one for each bucket of terms, as a row for each would cost more than counting.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.frames import as_bytes, pieces
from gridloom.llm.words import GOLDEN, mix
from gridloom.session import ship, store

#: A language keeps terms of at least so many of its documents; ranks of terms that are reported; the sum of a group's shares.
MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Entries a task counts, pairs of counts it holds, and bytes of text it cuts at a time (arrays beyond 1 MB cost page faults each time).
ENTRIES, PAIRS, PIECE = 400_000, 1_000_000, 1 << 19
#: Below this, two groups and two counts are sorted as one number.
KEYS = 1 << 63
#: Rows and bytes that a task merges or sends at a time.
ROWS, BYTES = 5_000, 1 << 20
#: Groups, and bytes of their names, up to which facts of groups are broadcast; beyond, rows meet them by shuffling.
BROADCAST_GROUPS, BROADCAST_BYTES = 20_000, 8 << 20
#: Parts that the groups of a language are dealt over where they meet each other without a broadcast.
PARTS = 256

#: A-Z become a-z; what no term contains becomes a blank.
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Odd factors of the bytes of a hashed term.
_FACTORS = mix(np.arange(64, dtype=np.uint64) * GOLDEN) | np.uint64(1)
_COUNTS = "bucket int, names binary, spans binary, terms binary, lens binary, cells binary"
_TERMS = "lang string, term string, total long, cells array<struct<source: string, n: long>>"
_TALLY = "lang string, one string, two string, a long, b long, m long"


class Cut(NamedTuple):
    """Terms of some texts: the different ones, and for each occurrence, in order, its term and its text."""

    terms: pa.Array
    term: np.ndarray
    text: np.ndarray


def terms_of(data: np.ndarray, begin: np.ndarray) -> Cut:
    """The terms of texts that lie behind each other in ``data`` and begin at ``begin``."""
    spelt = data.tobytes().translate(_LETTERS)
    solid = np.frombuffer(spelt, np.uint8) != 0x20
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    at = begin[begin < len(spelt)]
    first[at] = solid[at]  # no term goes on in the next text
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    starts = np.flatnonzero(first)
    ends = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(np.flatnonzero(last) - starts + 1, out=ends[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(spelt.translate(None, b" "))]).dictionary_encode()
    text = np.repeat(np.arange(len(begin)), np.diff(np.r_[np.searchsorted(starts, begin), len(starts)]))
    return Cut(words.dictionary, words.indices.to_numpy(), text)


def _first(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where rows differ from those before them."""
    new = np.zeros(len(sorted_columns[0]), bool)
    new[:1] = True
    for column in sorted_columns:
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else values[:0]


class _Tally:
    """Occurrences and documents of the terms of groups, as arrays."""

    def __init__(self) -> None:
        self.groups: dict[tuple[bytes, bytes], int] = {}
        self.terms = pa.array([], pa.binary())
        self.columns = [np.zeros(0, np.int64)] * 4  # term, group, documents, occurrences
        self.more: list[tuple[pa.Array, list[np.ndarray]]] = []
        self.held = 0

    def add(self, terms: pa.Array, columns: list[np.ndarray]) -> None:
        self.more.append((terms, columns))
        self.held += len(columns[0])

    def short(self, group: np.ndarray, data: np.ndarray, begin: np.ndarray) -> None:
        """Whole texts, of which each belongs to a group."""
        order = np.argsort(group, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        cut = terms_of(data, begin)
        key = cut.term.astype(np.int64) * len(begin) + place[cut.text]
        key.sort()  # by term, group, text
        each = _first(key)
        term, text = np.divmod(key[each], len(begin))
        of = group[order][text]
        first = _first(term, of)
        self.add(cut.terms, [term[first], of[first], np.diff(np.r_[first, len(each)]), np.diff(np.r_[each[first], len(key)])])

    def long(self, group: int, data: np.ndarray) -> None:
        """One text, piece by piece; a piece ends where a term does."""
        own, at = _Tally(), 0
        while at < len(data):
            end, blank = min(len(data), at + PIECE), -1
            while blank < 0 and end < len(data):  # the next byte that no term contains
                blank = data[end : end + PIECE].tobytes().translate(_LETTERS).find(b" ")
                end = min(len(data), end + PIECE) if blank < 0 else end + blank
            own.short(np.zeros(1, np.int64), data[at:end], np.zeros(1, np.int64))
            if own.held > 2 * max(ENTRIES, len(own.columns[0])):
                own.fold()
            at = end
        own.fold()
        term, of, _, n = own.columns
        self.add(own.terms, [term, of + group, np.ones_like(n), n])

    def fold(self) -> None:
        """Sum what was added since."""
        terms, columns = [self.terms, *(t for t, _ in self.more)], [self.columns, *(c for _, c in self.more)]
        self.more.clear()
        starts = np.cumsum([0, *map(len, terms)])
        spelt = pa.concat_arrays(terms).dictionary_encode()
        to = spelt.indices.to_numpy()
        term = np.concatenate([to[c[0] + start] for c, start in zip(columns, starts[:-1], strict=True)])
        group, docs, n = (np.concatenate([c[i] for c in columns]) for i in (1, 2, 3))
        order = np.argsort(term * np.int64(max(1, len(self.groups))) + group)
        term, group = term[order], group[order]
        first = _first(term, group)
        self.terms, self.columns = spelt.dictionary, [term[first], group[first], _sums(docs[order], first), _sums(n[order], first)]
        self.held = len(first)

    def blocks(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """A row for each bucket of terms, by a hash: the names of its groups, its terms, and numbers of each cell, in order."""
        term, group, docs, n = self.columns
        start = _first(term)  # each term has cells, in order
        much = np.diff(np.r_[start, len(term)])
        home = _hashed(self.terms) % np.uint64(buckets)
        place = np.argsort(home, kind="stable")
        t = np.r_[_first(home[place]), len(place)]
        start, much = start[place], much[place]
        ends = np.cumsum(much)
        cell = np.repeat(start - ends + much, much) + np.arange(len(term))
        first = np.r_[0, ends][t]
        block = np.repeat(np.arange(len(t) - 1), np.diff(first))
        known, of = np.unique(block * len(self.groups) + group[cell], return_inverse=True)  # groups are numbered anew within each block
        g = np.searchsorted(known, np.arange(len(t)) * len(self.groups))
        pairs = 2 * (known % max(1, len(self.groups)))
        names = pa.array([x for pair in self.groups for x in pair], pa.binary()).take(pa.array(np.stack([pairs, pairs + 1], 1).ravel()))
        cells = np.stack([np.repeat(np.arange(len(place)), much) - t[block], of - g[block], docs[cell], n[cell]], 1)
        parts = [*_joined(names, 2 * g), *_joined(self.terms.take(pa.array(place)), t), _packed(cells, first)]
        buckets_of = pa.array(home[place][t[:-1]].astype(np.int32))
        yield from pieces([pa.RecordBatch.from_arrays([buckets_of, *parts], names=["bucket", "names", "spans", "terms", "lens", "cells"])], 2000)

    def take(self, batch: pa.RecordBatch) -> None:
        """Add blocks of other tallies."""
        names, per_name = _parted(batch["names"], batch["spans"])
        terms, per_term = _parted(batch["terms"], batch["lens"])
        values, size = _values(batch["cells"], np.int64)
        cells = values.reshape(-1, 4)
        spelt = names.dictionary_encode()
        known, at = np.unique(spelt.indices.to_numpy().reshape(-1, 2), axis=0, return_inverse=True)
        words = spelt.dictionary.to_pylist()
        number = np.array([self.groups.setdefault((words[i], words[j]), len(self.groups)) for i, j in known.tolist()], np.int64)[at.ravel()]
        block = np.repeat(np.arange(len(size)), size // 4)
        starts = [(np.cumsum(x) - x)[block] for x in (per_term, per_name // 2)]
        self.add(terms, [starts[0] + cells[:, 0], number[starts[1] + cells[:, 1]], cells[:, 2], cells[:, 3]])
        if self.held > 2 * max(ENTRIES, len(self.columns[0])):
            self.fold()

    def kept(self, min_docs: int) -> Iterator[pa.RecordBatch]:
        """The terms in at least so many documents of their language, with cells by source in byte order."""
        self.fold()
        term, group, docs, n = self.columns
        names = list(self.groups)
        place, tongue = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
        langs = {lang: i for i, lang in enumerate(dict.fromkeys(lang for lang, _ in names))}
        for i, x in enumerate(sorted(range(len(names)), key=names.__getitem__)):
            place[x], tongue[x] = i, langs[names[x][0]]
        order = np.lexsort((place[group], term))  # the sources of a language are neighbours
        term, group, docs, n = term[order], group[order], docs[order], n[order]
        first = _first(term, tongue[group])
        much = np.diff(np.r_[first, len(term)])
        enough = _sums(docs, first) >= min_docs
        cell, total, first = np.repeat(enough, much), _sums(n, first)[enough], first[enough]
        sources = _spelt(source for _, source in names).take(pa.array(group[cell]))
        found = [
            _spelt(langs).take(pa.array(tongue[group[first]])),
            self.terms.take(pa.array(term[first])).cast(pa.string()),
            pa.array(total, pa.int64()),
            pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(much[enough])], pa.int32()), pa.StructArray.from_arrays([sources, pa.array(n[cell])], names=["source", "n"])),
        ]
        yield from pieces([pa.RecordBatch.from_arrays(found, names=["lang", "term", "total", "cells"])], ROWS)


def _hashed(words: pa.Array) -> np.ndarray:
    """A uint64 hash of each of some words, none empty."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset :][: len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
    at = np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], np.diff(ends))
    return mix(_sums(data * _FACTORS[at % len(_FACTORS)], ends[:-1] - ends[0]))


def _packed(values: np.ndarray, start: np.ndarray) -> pa.Array:
    """Rows of numbers as bytes, those of each block from its start to the next."""
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    if len(values) * width >= 1 << 31:
        raise OverflowError("a text has too many different terms for one block")
    return pa.Array.from_buffers(pa.binary(), len(start) - 1, [None, pa.py_buffer((start * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _values(blocks: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all blocks, and how many each has."""
    blocks = blocks.cast(pa.binary())
    start = np.frombuffer(blocks.buffers()[1], np.int32)[blocks.offset :][: len(blocks) + 1].astype(np.int64)
    width = np.dtype(kind).itemsize
    return np.frombuffer((blocks.buffers()[2] or pa.py_buffer(b"")).slice(int(start[0]), int(start[-1] - start[0])), kind), np.diff(start) // width


def _joined(words: pa.Array, start: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The bytes of the words of each block, and their lengths."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset :][: len(words) + 1]
    data = pa.Array.from_buffers(pa.binary(), len(start) - 1, [None, pa.py_buffer(ends[start]), words.buffers()[2]])
    return data, _packed(np.diff(ends), start)


def _parted(data: pa.Array, lens: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all blocks, and how many each has."""
    (text, _), (size, per_block) = _values(data, np.uint8), _values(lens, np.int32)
    ends = np.r_[0, np.cumsum(size)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(text)]), per_block


def _spelt(names: Iterable[bytes]) -> pa.Array:
    return pa.array(list(names), pa.binary()).cast(pa.string())


def _count(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Documents of each term of each language and its occurrences in each source, summed over a task as far as ENTRIES go."""
    tally = _Tally()
    for batch in batches:
        names = list(zip(as_bytes(batch.column(0)), as_bytes(batch.column(1)), strict=True))
        texts = batch.column(2).cast(pa.binary())
        begin = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset :][: len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        low = 0
        while low < len(names):  # as many whole texts as PIECE allows
            high = max(low + 1, int(np.searchsorted(begin, begin[low] + PIECE, "right")) - 1)
            group = np.array([tally.groups.setdefault(x, len(tally.groups)) for x in names[low:high]], np.int64)
            part = data[begin[low] : begin[high]]
            if len(part) > PIECE:
                tally.long(int(group[0]), part)
            else:
                tally.short(group, part, begin[low:high] - begin[low])
            low = high
            if tally.held > 2 * ENTRIES:
                tally.fold()
                if tally.held > ENTRIES:
                    yield from tally.blocks(buckets)
                    tally = _Tally()
    tally.fold()
    yield from tally.blocks(buckets)


def gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to ROWS rows or BYTES bytes, and what the last one adds."""
    held: list[pa.RecordBatch] = []
    rows = much = 0
    for batch in batches:
        held.append(batch)
        rows, much = rows + batch.num_rows, much + batch.nbytes
        if rows >= ROWS or much >= BYTES:
            yield pa.concat_batches(held)
            held, rows, much = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def _merge(batches: Iterable[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Kept terms, from blocks sorted by bucket; one bucket is held at a time."""
    tally, last = _Tally(), None
    for batch in batches:
        bucket = batch["bucket"].to_numpy()
        first = _first(bucket)
        for low, high in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True):
            if bucket[low] != last:
                yield from tally.kept(min_docs)
                tally, last = _Tally(), bucket[low]
            tally.take(batch.slice(low, high - low))
    yield from tally.kept(min_docs)


def _joint(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tallies of (count, count) over pairs of sources (one before two in byte order), of terms that both hold."""
    groups: dict[tuple[bytes, bytes], int] = {}
    values: dict[int, int] = {}
    parts: list[list[np.ndarray]] = []  # group, group, count, count (by their numbers), terms
    held = 0

    def fold() -> None:
        nonlocal held
        rows = [np.concatenate(x) for x in zip(*parts, strict=True)]
        g, c = len(groups), len(values)
        if g * g * c * c < KEYS:
            key = ((rows[0].astype(np.int64) * g + rows[1]) * c + rows[2]) * c + rows[3]
            order = np.argsort(key)
            first = _first(key[order])
        else:
            order = np.lexsort(rows[3::-1])
            first = _first(*(x[order] for x in rows[:4]))
        parts[:] = [[x[order][first] for x in rows[:4]] + [_sums(rows[4][order], first)]]
        held = len(first)

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held
        names, counts = list(groups), np.array(list(values), np.int64)
        langs, sources = _spelt(lang for lang, _ in names), _spelt(source for _, source in names)
        one, two, a, b, m = parts[0]
        columns = [langs.take(pa.array(one)), sources.take(pa.array(one)), sources.take(pa.array(two)), *(pa.array(x) for x in (counts[a], counts[b], m))]
        parts.clear()
        held = 0
        yield from pieces([pa.RecordBatch.from_arrays(columns, names=["lang", "one", "two", "a", "b", "m"])], ROWS)

    def met(at: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        nonlocal held
        parts.append([x.ravel() for x in (at[:, i], at[:, j], n[:, i], n[:, j])] + [np.ones(len(at) * len(i), np.int64)])
        held += len(at) * len(i)

    for batch in gathered(batches):
        size = pc.list_value_length(batch.column(1)).to_numpy()
        lang = batch.column(0).cast(pa.binary()).dictionary_encode()
        source = batch.column(1).flatten().cast(pa.binary()).dictionary_encode()
        langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
        known, at = np.unique(np.repeat(lang.indices.to_numpy(), size).astype(np.int64) * len(sources) + source.indices.to_numpy(), return_inverse=True)
        number = [groups.setdefault((langs[x // len(sources)], sources[x % len(sources)]), len(groups)) for x in known.tolist()]
        at = np.array(number, np.int32)[at]
        known, n = np.unique(batch.column(2).flatten().to_numpy(), return_inverse=True)
        n = np.array([values.setdefault(x, len(values)) for x in known.tolist()], np.int32)[n]
        begin = np.cumsum(size) - size
        for k in np.unique(size).tolist():
            rows, low = begin[size == k], 0
            if k * (k - 1) // 2 > PAIRS:  # one term after the other, as many rows of its triangle of pairs as PAIRS allow
                for row in rows.tolist():
                    low = 0
                    while low < k - 1:
                        high = min(k - 1, low + max(1, PAIRS // k))
                        i, j = np.triu_indices(high - low, 1, k - low)
                        met(at[None, row + low : row + k], n[None, row + low : row + k], i, j)
                        low = high
                        if held > PAIRS:
                            fold()
                            if held > PAIRS // 2:
                                yield from flush()
                continue
            i, j = np.triu_indices(k, 1)
            step = max(1, PAIRS // max(1, len(i)))
            for low in range(0, len(rows), step):
                where = rows[low : low + step, None] + np.arange(k)
                met(at[where], n[where], i, j)
                if held > PAIRS:
                    fold()
                    if held > PAIRS // 2:
                        yield from flush()
    if parts:
        fold()
        yield from flush()


def _share(count: Column | str, total: Column | str, kept: Column | str) -> Column:
    """1 + floor(SCALE (count + 1) / (total + kept)) in whole numbers, of up to 38 digits where 64 bits don't hold them."""
    count, whole = F.col(count) + 1, F.col(total) + F.col(kept)
    wide = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * count.cast("decimal(20,0)"), whole.cast("decimal(20,0)"))
    return F.when(count <= 9 * SCALE, F.call_function("div", F.lit(SCALE).cast("long") * count, whole)).otherwise(wide) + 1


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _read(docs: DataFrame, **columns: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(name) for name, c in columns.items()))


def counted(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """bucket, names, spans, terms, lens, cells: tallies of tasks as blocks, one for each bucket of terms.

    Rows for each term would cost more than their counting. There are twice as many buckets as partitions of a shuffle.
    """
    ship(docs.sparkSession)
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _read(docs, lang=lang_col, source=source_col, text=text_col).mapInArrow(lambda batches: _count(batches, buckets), _COUNTS)


def vocabulary(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, total, cells: the kept terms of each language, with the count of each source that has the term.

    A row holds at most one cell for each source of the language, in byte order, after all documents are summed.
    """
    ship(counts.sparkSession)
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, as a hash would give some parts many buckets
    return counts.repartitionById(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: _merge(batches, min_docs), _TERMS)


def _facts(df: DataFrame, label: str) -> DataFrame:
    """A table of groups, stored, and broadcast if its counted size is small."""
    kept = store(df, label)
    size = sum((F.octet_length(c) for c, kind in kept.dtypes if kind == "string"), F.lit(0))
    rows, of_names = kept.agg(F.count(F.lit(1)), F.sum(size)).first()
    return F.broadcast(kept) if rows <= BROADCAST_GROUPS and (of_names or 0) <= BROADCAST_BYTES else kept


def _pairs(groups: DataFrame, one: list[Column], two: list[Column]) -> DataFrame:
    """Each two groups of a language, of which ``one`` comes first: as many rows as the audit must return."""
    left = groups.select("lang", F.col("source").alias("one"), *one, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    right = groups.select("lang", F.col("source").alias("two"), *two, F.pmod(F.xxhash64("source"), F.lit(PARTS)).cast("int").alias("part"))
    return left.join(right, ["lang", "part"]).where(F.col("one") < F.col("two")).drop("part")


def joint_histograms(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, one, two, a, b, m: how many kept terms have count a in one and b in two, zeros included; one before two.

    ``groups``: lang, source, kept (terms with a count there), v (kept terms of the language).
    """
    return signed_cells(terms, groups).groupBy("lang", "one", "two", "a", "b").agg(F.sum("m").alias("m"))


def signed_cells(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """Joint histograms as parts whose sums by cell they are: what is added to a cell, or taken from it, in rows of their own."""
    ship(terms.sparkSession)
    split = terms.select("lang", F.col("cells.source").alias("sources"), F.col("cells.n").alias("counts")).where(F.size("sources") > 1)
    both = split.mapInArrow(_joint, _TALLY).groupBy("lang", "one", "two", "a", "b").agg(F.sum("m").alias("m"))
    both = store(both, "joint")
    own = terms.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source"), F.col("c.n").alias("n"))
    own = store(own.agg(F.count(F.lit(1)).alias("m")), "histograms")
    pairs = _pairs(groups, [F.col("kept").alias("k1"), F.col("v")], [F.col("kept").alias("k2")])
    zero = F.lit(0).cast("long")
    key = [F.col("lang"), F.col("one"), F.col("two")]
    left = pairs.join(own.withColumnRenamed("source", "one"), ["lang", "one"]).select(*key, F.col("n").alias("a"), zero.alias("b"), "m")
    right = pairs.join(own.withColumnRenamed("source", "two"), ["lang", "two"]).select(*key, zero.alias("a"), F.col("n").alias("b"), "m")
    none = pairs.select(*key, zero.alias("a"), zero.alias("b"), (F.col("v") - F.col("k1") - F.col("k2")).alias("m"))
    cell = lambda a, b, m: F.struct(a.alias("a"), b.alias("b"), m.alias("m"))
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    given = both.select(*key, F.explode(F.array(cell(a, b, m), cell(a, zero, -m), cell(zero, b, -m), cell(zero, zero, m))).alias("c")).select(*key, "c.*")
    return given.unionByName(left).unionByName(right).unionByName(none)


def audit(
    docs: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    top: int = TOP,
) -> DataFrame:
    """lang, source, part, item, value, rank: how far each group is from the others of its language, and by which terms.

    A group's share of a kept term is p = 1 + floor(SCALE (count + 1) / (N + V)), N its occurrences of kept
    terms and V their number; a language has shares in the same way. f(p, q) = floor((p - q)^2 / q).
    ``pair`` rows: the sum of f over all kept terms against each other source; ``term`` rows: f against the whole language for the
    terms that the group has more of than the language, the first ``top`` of them. Ranks go by value, then by item in
    byte order. All numbers are whole; a sum beyond 2^63 is an error.

    Null languages, sources and texts are ''. Empty texts have no terms, but their groups count; texts of any
    length are cut piece by piece. Rows that repeat count each time. A language that keeps no term gives pairs of value 0. An empty
    table gives no row. Further columns are not read, whatever their names.
    """
    terms = store(vocabulary(counted(docs, lang_col, source_col, text_col), min_docs), "terms")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("all"))
    sums = terms.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source"))
    sums = sums.agg(F.sum("c.n").alias("n"), F.count(F.lit(1)).alias("kept"))
    known = _read(docs, lang=lang_col, source=source_col).distinct()
    filled = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("n", "kept", "v", "all")]
    groups = known.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *filled)
    groups = _facts(groups, "groups")

    # values are sums over cells, so parts of cells need not meet first: the squares of a group's shares sum to about SCALE squared at
    # most, and so do the values of each kind of part, far below 2^63
    cells = signed_cells(terms, groups).where(F.col("m") != 0)
    for name, total in (("one", "n1"), ("two", "n2")):
        cells = cells.join(groups.select("lang", F.col("source").alias(name), F.col("n").alias(total), F.col("v").alias(f"v{total}")), ["lang", name])
    p, q = _share("a", "n1", "vn1"), _share("b", "n2", "vn2")
    sides = cells.select("lang", "one", "two", "m", p.alias("p"), q.alias("q")).select(
        "lang", "one", "two", (F.col("m") * _gap(F.col("p"), F.col("q"))).alias("there"), (F.col("m") * _gap(F.col("q"), F.col("p"))).alias("back")
    )
    values = sides.groupBy("lang", "one", "two").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
    # pairs of a language without kept terms have no cell
    bare = _pairs(groups.where(F.col("v") == 0), [], [])
    values = values.unionByName(bare.withColumns({"there": F.lit(0).cast("long"), "back": F.lit(0).cast("long")}))
    way = lambda source, item, value: F.struct(F.col(source).alias("source"), F.col(item).alias("item"), F.col(value).alias("value"))
    pair = values.select("lang", F.explode(F.array(way("one", "two", "there"), way("two", "one", "back"))).alias("w")).select("lang", "w.*")
    pair = _ranked(pair, "pair")

    own = terms.select("lang", "term", "total", F.explode("cells").alias("c")).select("lang", "term", "total", "c.*")
    own = own.join(groups.select("lang", "source", F.col("n").alias("sum"), "v", "all"), ["lang", "source"])
    own = own.select("lang", "source", F.col("term").alias("item"), _share("n", "sum", "v").alias("p"), _share("total", "all", "v").alias("q"))
    own = own.where(F.col("p") > F.col("q")).select("lang", "source", "item", _gap(F.col("p"), F.col("q")).alias("value"))
    return pair.unionByName(_ranked(own, "term").where(F.col("rank") <= top))


def _ranked(df: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit_sql() -> str:
    """The audit in SQL for DuckDB, over the table documents: every pair of sources term by term."""
    share = lambda count, total: f"(1 + ({SCALE}::HUGEINT * ({count} + 1)) // ({total} + v))"
    gap = lambda p, q: f"((({p} - {q}) * ({p} - {q})) // {q})"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x{{00}}-\\x{{40}}\\x{{5B}}-\\x{{60}}\\x{{7B}}-\\x{{7F}}]+') AS ts FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT i, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= {MIN_DOCS}),
vs AS (SELECT lang, count(*) AS v, sum(total) AS whole FROM kept GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n) AS s FROM n GROUP BY ALL),
p AS (SELECT g.lang, g.source, term, coalesce(n.n, 0) AS n, {share("coalesce(n.n, 0)", "coalesce(s, 0)")} AS p, {share("total", "whole")} AS q
  FROM g JOIN kept USING (lang) JOIN vs USING (lang) LEFT JOIN n USING (lang, source, term) LEFT JOIN sums USING (lang, source)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum({gap("a.p", "b.p")}) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, {gap("p", "q")}::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM every)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= {TOP}"""
