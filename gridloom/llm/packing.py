"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

The plan needs only how many pieces there are of each length, at most ``capacity``
numbers, so the driver makes it for any corpus:

1. Pieces above a third of the capacity (at most two fit together) are matched
   greedily: the longest with the longest that still fits.
2. Smaller ones, longest first, go to the fullest sequence that has room, or to a
   new one.

Runs of sequences with equal content are handled together; a plan is a list of runs.
A piece finds its place by its rank among pieces of its length: a rank inside the
task that tokenised it plus the counts of the tasks before, both stored.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.llm.frames import memory, partition_id
from gridloom.session import ship, store

CAPACITY, END_ID = 4096, 1
TOKENIZER = "word_bpe_49k.json"
#: Text that is tokenised together; longer texts are tokenised in parts of this.
LEARN_BYTES, LEARN_ROWS = 4 << 20, 8192
#: Words whose ids a worker remembers, and the longest such word in bytes.
CACHE_ENTRIES, CACHED_BYTES = 300_000, 64
#: The ASCII marks, of which up to MARK_BYTES may follow a word, and the ends and whole words they may follow.
MARKS, MARK_BYTES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", 8
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_LETTER_LAST, _LETTERS = r"[\p{Ll}\p{Lo}]\z", r"\A[\p{Ll}\p{Lo}]+\z"


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """pool[start : start + length] of each pair, end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(pool)) < 1 << 31 else np.int64
    at = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return pool[at]


class WordIds:
    """Ids of texts for tokenizers that drop white space: a text's ids are those of its words.

    Words are cut at ASCII white space only, which the tokenizer's pattern also never
    crosses; everything else is left to the tokenizer. Arrow splits the texts and numbers their
    distinct words; Python sees only these.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = [i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[ends] = True
        self.seen: dict[bytes, bytes] = {}  # of late
        self.old: dict[bytes, bytes] = {}  # before

    def _encode(self, words: pa.Array) -> list[bytes]:
        """The ids of each of some words without white space, many in one text.

        A word of letters only is one piece for the tokenizer, of which the last id alone marks an
        end; for others the ids' offsets tell the words apart.
        """
        texts, out = words.to_pylist(), [b""] * len(words)
        letters = pc.match_substring_regex(words, _LETTERS).to_numpy(zero_copy_only=False)
        plain, rest = np.flatnonzero(letters).tolist(), np.flatnonzero(~letters).tolist()

        def put(part: list[int], ids: np.ndarray, cuts: np.ndarray) -> None:
            data, places = ids.astype("<u4").tobytes(), (4 * cuts).tolist()
            for i, a, b in zip(part, places, places[1:], strict=False):
                out[i] = data[a:b]

        for at in range(0, len(plain), 8192):
            part = plain[at : at + 8192]
            ids = np.array(
                self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in part])], add_special_tokens=False)[0].ids,
                np.int64,
            )
            cuts = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1]) if len(ids) else np.zeros(1, np.int64)
            if len(cuts) == len(part) + 1 and cuts[-1] == len(ids):
                put(part, ids, cuts)
            else:
                rest += part
        for at in range(0, len(rest), 8192):
            part = rest[at : at + 8192]
            got = self.tokenizer.encode(" ".join([texts[i] for i in part]), add_special_tokens=False)
            ends = np.cumsum([len(texts[i]) + 1 for i in part])
            owner = np.searchsorted(ends, np.fromiter((o[0] for o in got.offsets), np.int64, len(got.ids)), "right")
            put(part, np.array(got.ids, np.int64), np.searchsorted(owner, np.arange(len(part) + 1)))
        return out

    def known(self, words: pa.Array) -> list[bytes]:
        """The ids of distinct words, as little-endian uint32."""
        if len(self.seen) > CACHE_ENTRIES // 2:
            self.old, self.seen = self.seen, {}
        seen = self.seen
        keys = words.cast(pa.binary()).to_pylist()
        ids = list(map(seen.get, keys))
        new = [i for i, x in enumerate(ids) if x is None]
        if new and self.old:
            for i in new:
                if (x := self.old.get(keys[i])) is not None:
                    ids[i] = seen[keys[i]] = x
            new = [i for i in new if ids[i] is None]
        if new:
            for i, x in zip(new, self._encode(words.take(pa.array(new, pa.int32()))), strict=True):
                ids[i] = x
                if len(keys[i]) <= CACHED_BYTES:
                    seen[keys[i]] = x
        return ids

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's begin (and the last one's end).

        A word is looked up by its stem in ASCII lower case and by the ASCII marks after it: the
        tokenizer lowers case itself, and marks that end a word are a piece of their own after
        a letter. Words that may hold a special token are left as they are.
        """
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        at = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        whole = coded.dictionary
        if not len(whole):
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        low = pc.ascii_lower(whole)
        bare = pc.ascii_rtrim(low, characters=MARKS)
        tail = pc.subtract(pc.binary_length(low), pc.binary_length(bare))
        special = pc.match_substring(whole, "<|")
        cut = pc.and_(
            pc.and_(pc.greater(tail, 0), pc.less_equal(tail, MARK_BYTES)),
            pc.and_(pc.match_substring_regex(bare, _LETTER_LAST), pc.invert(special)),
        )
        stems = pc.if_else(cut, bare, pc.if_else(special, whole, low)).dictionary_encode()
        # The marks as numbers of MARK_BYTES bytes.
        tails = np.where(cut.to_numpy(zero_copy_only=False), tail.to_numpy(), 0)
        _, offsets, data = low.buffers()
        last = np.frombuffer(offsets, np.int32)[low.offset + 1 : low.offset + 1 + len(low)].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data else np.zeros(1, np.uint8)
        back = np.arange(MARK_BYTES)
        marks = np.where(back < tails[:, None], raw[np.maximum(last[:, None] - 1 - back, 0)], 0).astype(np.uint8)
        names, mark = np.unique(marks.view(np.uint64)[:, 0], return_inverse=True)
        spelled = [int(x).to_bytes(MARK_BYTES, "little").rstrip(b"\0")[::-1] for x in names.tolist()]
        ids = self.known(stems.dictionary) + self.known(pa.array(spelled, pa.binary()).cast(pa.string()))
        pool = np.frombuffer(b"".join(ids), "<u4")
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(lengths) - lengths
        # A word's ids are its stem's and its marks'; then a text's are those of its words.
        both = np.stack([stems.indices.to_numpy(), len(stems.dictionary) + mark], axis=1).reshape(-1)
        pool = gather(pool, starts[both], lengths[both])
        lengths = lengths[both].reshape(-1, 2).sum(axis=1)
        starts = np.cumsum(lengths) - lengths
        use = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(lengths[use])])
        return gather(pool, starts[use], lengths[use]), ends[at]


_encoders: dict[str, WordIds] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def forget() -> None:
    """Drop this worker's encoders; a function, as a closure would carry a copy of the table."""
    _encoders.clear()


def _encoder(path: str) -> WordIds:
    if path not in _encoders:
        _encoders[path] = WordIds(path if os.path.isabs(path) else tokenizer_path(path))
    return _encoders[path]


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text cut after white space, into parts of about LEARN_BYTES."""
    at = 0
    while len(text) - at > LEARN_BYTES:
        space = _SPACE.search(text, at + LEARN_BYTES)
        stop = space.end() if space else len(text)
        yield text[at:stop]
        at = stop
    yield text[at:]


def tokenised(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """The id and the token ids of each row; LEARN_BYTES at a time, as the more words are looked up together, the fewer in all."""

    def ids(texts: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
        gc.disable()  # the tables of words hold no cycles; going through them again and again is slow
        try:
            with memory("packing", forget):
                return _encoder(path).ids(pa.concat_arrays(texts))
        finally:
            gc.enable()

    def out(keys: list, texts: list[pa.Array]) -> Iterator[tuple[int | None, np.ndarray]]:
        got, at = ids(texts)
        yield from ((key, got[a:b]) for key, a, b in zip(keys, at, at[1:], strict=False))

    keys, texts, size = [], [], 0
    for batch in batches:
        column = batch["text"].cast(pa.string())
        long = pc.fill_null(pc.binary_length(column), 0).to_numpy()
        first = 0
        for i in range(batch.num_rows):
            if long[i] > LEARN_BYTES:
                if i > first:
                    texts.append(column.slice(first, i - first))
                if texts:
                    yield from out(keys, texts)
                yield batch["id"][i].as_py(), np.concatenate([ids([pa.array([x], pa.binary()).cast(pa.string())])[0] for x in _parts(column[i].as_py().encode())])
                keys, texts, size, first = [], [], 0, i + 1
                continue
            keys.append(batch["id"][i].as_py())
            size += int(long[i])
            if size >= LEARN_BYTES or len(keys) >= LEARN_ROWS:
                yield from out(keys, [*texts, column.slice(first, i + 1 - first)])
                keys, texts, size, first = [], [], 0, i + 1
        if first < batch.num_rows:
            texts.append(column.slice(first))
    if keys:
        yield from out(keys, texts)


_PIECE = {
    "doc_id": pa.int64(),
    "piece": pa.int32(),
    "start": pa.int64(),
    "length": pa.int64(),
    "ids_crc32": pa.int64(),
    "src": pa.int64(),
    "local": pa.int64(),
}


def _tokenise(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, src, rows = Counter(), partition_id(), []
        for key, ids in tokenised(batches, path):
            data = ids.astype("<u4").tobytes() + end
            for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                part = data[at : at + 4 * capacity]
                length = len(part) // 4
                rows.append((key, piece, at // 4, length, zlib.crc32(part), src, ranks[length]))
                ranks[length] += 1
            if len(rows) >= LEARN_ROWS:
                yield _rows(rows, _PIECE)
                rows = []
        if rows:
            yield _rows(rows, _PIECE)

    return run


def _rows(rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields.values(), strict=True)], list(fields))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first sequence, pieces in each sequence, offset).

    Of a run, the pieces of this length with the ranks first, first + 1, ... go to
    first sequence, in each so many from this offset on, then to the next one.
    """
    left = {s: n for s, n in counts.items() if n}
    given: Counter[int] = Counter()
    runs: list[tuple[int, int, int, int, int]] = []
    free: dict[int, deque[tuple[int, int]]] = {}  # room -> runs of sequences (first, number)
    rooms: list[int] = []  # sorted
    sequences = 0

    def put(size: int, number: int, first: int, each: int, offset: int) -> None:
        if number:
            runs.append((size, given[size], first, each, offset))
            given[size] += number

    def keep(room: int, first: int, number: int) -> None:
        if room and number:
            if not free.get(room):
                free[room] = deque()
                insort(rooms, room)
            free[room].append((first, number))

    large = sorted(s for s in left if 3 * s > capacity)
    def take(size: int, number: int) -> None:
        left[size] -= number
        if not left[size]:
            large.remove(size)

    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        if at >= 0 and large[at] == a and left[a] > 1:
            n = left[a] // 2
            put(a, 2 * n, sequences, 2, 0)
            keep(capacity - 2 * a, sequences, n)
            take(a, 2 * n)
        elif (at := at - (at >= 0 and large[at] == a)) < 0:  # nothing fits beside it
            n = left[a]
            put(a, n, sequences, 1, 0)
            keep(capacity - a, sequences, n)
            take(a, n)
        else:
            b = large[at]
            n = min(left[a], left[b])
            put(a, n, sequences, 1, 0)
            put(b, n, sequences, 1, a)
            keep(capacity - a - b, sequences, n)
            take(a, n)
            take(b, n)
        sequences += n
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[size]
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):  # new sequences
                each = capacity // size
                full, over = divmod(n, each)
                put(size, n, sequences, each, 0)
                keep(capacity - each * size, sequences, full)
                if over:
                    keep(capacity - over * size, sequences + full, 1)
                sequences += full + bool(over)
                break
            room = rooms[at]
            first, number = free[room].popleft()
            if not free[room]:
                rooms.pop(at)
            each = room // size
            full = min(number, n // each)
            over = min(n - full * each, each) if full < number else 0
            put(size, full * each + over, first, each, capacity - room)
            keep(room - each * size, first, full)
            if over:
                keep(room - over * size, first + full, 1)
            keep(room, first + full + bool(over), number - full - bool(over))
            n -= full * each + over
    return runs


def _placer(runs: list[tuple[int, int, int, int, int]]):
    size, first, sequence, each, offset = (np.array(c, np.int64) for c in zip(*sorted(runs), strict=True)) if runs else (np.empty(0, np.int64),) * 5
    starts = {int(s): int(i) for i, s in reversed(list(enumerate(size)))}
    ends = {int(s): int(i) + 1 for i, s in enumerate(size)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            run = np.empty(len(lengths), np.int64)
            for s in np.unique(lengths).tolist():
                own = lengths == s
                a, b = starts[s], ends[s]
                run[own] = a + np.searchsorted(first[a:b], ranks[own], "right") - 1
            nth = ranks - first[run]
            columns = {c: batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            columns |= {
                "sequence_id": pa.array(sequence[run] + nth // each[run]),
                "offset": pa.array(offset[run] + nth % each[run] * lengths),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return place


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are the tokenizer's, without special tokens, then ``end_id``; null
    text counts as empty. Documents of more than ``capacity`` ids are cut into pieces of
    that many, of which the last may be shorter. Each row of ``docs`` is packed, rows with
    the same or a null id too. Other columns are not read. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, src long, local long"
    cut = store(rows.mapInArrow(_tokenise(tokenizer, capacity, end_id), fields), "pieces")
    by_task = store(cut.groupBy("src", "length").count(), "lengths")
    before = F.coalesce(
        F.sum("count").over(Window.partitionBy("length").orderBy("src").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    firsts = by_task.select("src", "length", before.alias("first"))
    total = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("count").alias("n")).toLocalIterator()}  # at most ``capacity`` rows
    # The table of firsts grows with tasks times lengths, so it is never broadcast.
    ranked = cut.join(firsts.hint("merge"), ["src", "length"]).withColumn("rank", F.col("first") + F.col("local"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(
        _placer(plan(total, capacity)),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )


def sequences(
    docs: DataFrame,
    packed: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and the pieces' doc_ids and offsets.

    ``docs`` must have one row for each id that ``packed`` names.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = {"doc_id": pa.int64(), "piece": pa.int32(), "ids": pa.list_(pa.int32())}
        for key, ids in tokenised(batches, tokenizer):
            data = np.append(ids, end_id).astype(np.int32)
            yield _rows([(key, n, data[at : at + capacity]) for n, at in enumerate(range(0, len(data), capacity))], fields)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ])
    held = rows.mapInArrow(cut, schema).join(packed, ["doc_id", "piece"])
    parts = held.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return parts.select(
        "sequence_id",
        F.flatten("parts.ids").alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
        F.col("parts.offset").alias("offsets"),
    )
