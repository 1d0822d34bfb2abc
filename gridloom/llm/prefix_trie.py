"""The trie of conversation prefixes, from sorted conversations and their common prefixes.

Distinct conversations are sorted as sequences of turn digests. Between neighbours stands the length of their common
prefix; the maximal ranges over which it stays at or above a value are the branching nodes of the trie, and such a range ends at the
nearest smaller values on both sides (it is a node of the Cartesian tree over these lengths, equal ones merged). Blocks of the sorted
order find them in parallel with one stack each. What a block can't decide are the minima of its prefixes and suffixes, at
most a few for each depth: these, with sums over what lies between, form a much shorter sequence of the same kind, which the same
sweep decides. Depths without a branch are filled in last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.frames import as_batches, attach, partition_id
from gridloom.session import ship, store

#: Bytes of a turn's digest.
DIGEST = 16
#: Sequences to a block; items that one task decides at the end, and blocks to a block of the next level above that.
BLOCK, LAST_ITEMS, FAN = 50_000, 1_000_000, 256
#: Ids whose decimals are joined at once are those that agree above this many bits.
ID_BITS = 12

_NO_ENDS = hashlib.sha256(b"").hexdigest()
_FOUND = (
    "unit long, seq long, gap int, gaps long, single boolean, key binary, words array<int>, n long, low long, total long, fresh long, "
    "leaves long, length int, ends string, parent binary, node binary, start int, children long, before array<long>"
)
_ITEM = [c.split()[0] for c in _FOUND.split(", ")[:14]]


class Part:
    """Sums over neighbouring sequences: members, least id, words of all members, words of distinct nodes, leaves; the first sequence's length and ends.

    ``fresh`` counts the words of each node once, from the root down. ``single``: one sequence whose own nodes are still to be told.
    """

    __slots__ = ("ends", "fresh", "key", "leaves", "length", "low", "n", "single", "total", "words")

    def __init__(self, n, low, total, fresh, leaves, length, ends, single=False, key=b"", words=()):
        self.n, self.low, self.total, self.fresh, self.leaves, self.length, self.ends = n, low, total, fresh, leaves, length, ends
        self.single, self.key, self.words = single, key, words


class Branch:
    """An open range: a common prefix of ``gap`` turns, what lies before its first gap, and what has come between its gaps."""

    __slots__ = ("before", "first", "gap", "gaps", "key", "more", "words")

    def __init__(self, gap, gaps, key, words, first):
        self.gap, self.gaps, self.key, self.words, self.first = gap, gaps, key[: gap * DIGEST], words[:gap], first
        self.before = sum(self.words)
        self.more = Part(0, None, 0, self.before, 0, 0, None)

    def add(self, part: Part) -> None:
        more = self.more
        more.n += part.n
        more.low = part.low if more.low is None else min(more.low, part.low)
        more.total += part.total
        more.fresh += part.fresh - self.before
        more.leaves += part.leaves

    def whole(self) -> Part:
        a, b = self.first, self.more
        low = a.low if b.low is None else min(a.low, b.low)
        return Part(a.n + b.n, low, a.total + b.total, a.fresh + b.fresh - self.before, a.leaves + b.leaves, a.length, a.ends)


def common(a: bytes, b: bytes) -> int:
    """Turns at the start of two sequences that agree."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * DIGEST : middle * DIGEST] == b[low * DIGEST : middle * DIGEST]:
            low = middle
        else:
            high = middle - 1
    return low


def _name(key: bytes, depth: int) -> bytes:
    return hashlib.sha256(key[: depth * DIGEST]).digest()[:DIGEST] + depth.to_bytes(4, "big")


def _chain(above: int, depth: int, part: Part, key: bytes, words: list[int], children: int | None) -> tuple:
    """The nodes from below depth ``above`` down to ``depth``, which have the same members; children is None below a branch."""
    sums = [0, 0, *accumulate(words[: depth - 1])] if depth > 0 else [0]  # words above depths 0, 1, 2, ...
    return (
        None, None, None, None, None, None, None, part.n, part.low, part.total, part.fresh, part.leaves, None,
        part.ends if part.length == depth else None,
        _name(key, above) if above >= 0 else None,
        None if children is None else _name(key, depth),
        above + 1,
        children or 0,
        sums[above + 1 : depth + 1],
    )


class Sweep:
    """One pass over items from left to right; ``final``: nothing lies beyond either end.

    An item is a gap (None: between the single sequence before and this one) and the part behind it.
    """

    def __init__(self, unit: int, final: bool):
        self.unit, self.final = unit, final
        self.stack: list[Branch] = []
        self.head: list[Branch] = []
        self.start: Part | None = None
        self.last: Part | None = None

    def put(self, gap: int | None, gaps: int, part: Part) -> Iterator[tuple]:
        if self.last is None:
            self.last = part
            return
        if gap is None:
            gap = common(self.last.key, part.key)
        yield from self._close(gap)
        if self.stack and self.stack[-1].gap == gap:
            self.stack[-1].gaps += gaps
            self.stack[-1].add(self.last)
        else:
            self.start = self.start or self.last
            self.stack.append(Branch(gap, gaps, part.key, part.words, self.last))
        self.last = part

    def _close(self, gap: int) -> Iterator[tuple]:
        """Tell all ranges that end at a gap of this value."""
        part, stack = self.last, self.stack
        if part.single and (stack or self.final):
            above = max(gap, stack[-1].gap if stack else -1)
            told = Part(part.n, part.low, part.total, part.fresh, int(gap < part.length), part.length, part.ends)
            if above < part.length:
                yield _chain(above, part.length, told, part.key, part.words, None)
            part = told
        while stack and stack[-1].gap > gap:
            branch = stack.pop()
            branch.add(part)
            whole = branch.whole()
            if stack or self.final:
                above = max(gap, stack[-1].gap if stack else -1)
                yield _chain(above, branch.gap, whole, branch.key, branch.words, branch.gaps + (whole.length > branch.gap))
            else:
                self.head.append(branch)
            part = whole
        self.last = part

    def end(self) -> Iterator[tuple]:
        if self.last is None:
            return
        if self.final:
            yield from self._close(-1)
            return
        items = [(None, 1, self.start or self.last)]
        for branch in self.head:
            items.append((branch.gap, branch.gaps, self._of(branch, branch.more)))
        behind_each = [*(b.first for b in self.stack[1:]), self.last]
        for branch, behind in zip(self.stack, behind_each, strict=False):  # a single sequence has no branch
            if branch.gaps > 1:
                items.append((branch.gap, branch.gaps - 1, self._of(branch, branch.more)))
            items.append((branch.gap, 1, behind if behind.single else self._of(branch, behind)))
        for seq, (gap, gaps, p) in enumerate(items):
            yield (self.unit, seq, gap, gaps, p.single, p.key, p.words, p.n, p.low, p.total, p.fresh, p.leaves, p.length, p.ends, None, None, None, None, None)

    @staticmethod
    def _of(branch: Branch, p: Part) -> Part:
        return Part(p.n, p.low, p.total, p.fresh, p.leaves, p.length, p.ends, False, branch.key, branch.words)


def _size(row: tuple) -> int:
    return 200 + len(row[5] or b"") + 4 * len(row[6] or ()) + 8 * len(row[18] or ())


def _sequences(batches: Iterable[pa.RecordBatch]) -> Iterator[Part]:
    """Neighbouring rows of one key make one sequence; its ids pass on to SHA-256 as they come."""
    key = None
    for batch in batches:
        for now, words, n, low, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key is None or now != key:
                if key is not None:
                    yield Part(members, least, members * sum(turns), sum(turns), 0, len(turns), digest.hexdigest(), True, key, turns)
                key, turns, members, least, digest = now, words, 0, low, hashlib.sha256()
            digest.update((b"," if members else b"") + ids.encode())
            members, least = members + n, min(least, low)
    if key is not None:
        yield Part(members, least, members * sum(turns), sum(turns), 0, len(turns), digest.hexdigest(), True, key, turns)


def _first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block of sequences: the ranges that lie within it, and items for the rest."""

    def rows() -> Iterator[tuple]:
        sweep = Sweep(partition_id(), False)
        for part in _sequences(batches):
            yield from sweep.put(None, 1, part)
        yield from sweep.end()

    return as_batches(_FOUND, rows(), _size)


def _again(fan: int | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Items of ``fan`` blocks become those of one; None: of all blocks, and nothing is left open."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        sweep = None
        for batch in batches:
            for unit, _, gap, gaps, single, key, words, *sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                unit = 0 if fan is None else unit // fan
                if sweep is None or sweep.unit != unit:
                    if sweep is not None:
                        yield from sweep.end()
                    sweep = Sweep(unit, fan is None)
                yield from sweep.put(gap, gaps, Part(*sums, single, key, words))
        if sweep is not None:
            yield from sweep.end()

    return lambda batches: as_batches(_FOUND, rows(batches), _size)


def turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turn, digest (hex of the first DIGEST bytes of a SHA-256 over role and text), words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    rows = conversations.where(F.col(conv_col).isNotNull())
    return rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), words.cast("int").alias("words"))


def sequences(rows: DataFrame) -> DataFrame:
    """conv_id, key (digests one after another), words (of each turn), from rows of ``turns``."""
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "words"))).alias("own"))
    return gathered.select("conv_id", *_sequence(F.col("own")))


def rebuilt(rows: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """``sequences`` in which the first h turns are those of the group's first conversation.

    A conversation c takes the first h turns of conversation c - c % group (all if it has fewer, none if there is
    none), then its own after its first h; h is the unsigned CRC-32 of its decimal id modulo ``heads``. The remainder has the
    sign of c. At most ``group`` conversations meet, and of the first of them only heads - 1 turns travel.
    """
    base = F.col("conv_id") - F.col("conv_id") % group
    gathered = rows.withColumn("base", base).repartition("base").groupBy("base", "conv_id")
    gathered = gathered.agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "words"))).alias("own"))
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, max(1, heads - 1)))).over(Window.partitionBy("base"))
    none = F.slice("own", 1, 0)
    gathered = gathered.select("conv_id", "own", F.coalesce(head, none).alias("head"), (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int").alias("h"))
    joined = F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own")))
    return gathered.select("conv_id", *_sequence(joined))


def _sequence(turns_of: Column) -> list[Column]:
    key = F.unhex(F.array_join(F.transform(turns_of, lambda x: x["digest"]), ""))
    return [key.alias("key"), F.transform(turns_of, lambda x: x["words"]).alias("words")]


def trie(found: DataFrame, block: int | None = None, last_items: int | None = None, fan: int | None = None) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row for each node.

    ``found``: conv_id, key, words of ``sequences`` or ``rebuilt``. A node of depth d is a distinct sequence of first d turns; its
    members start with it, and conv_id is the smallest of them (parent_conv_id likewise, null at the root, which has depth 0 and
    no text). n_leaves counts nodes without children in its subtree, itself included; saved_tokens sums (members - 1) times the words of the
    last turn over the subtree; ends_sha256 is over the members of exactly d turns: their decimal ids in numeric order, joined by commas.

    Conversations without turns are members of the root. Equal conversations are one sequence, however many; ids of a sequence
    are joined in parts by many tasks and hashed in order by one, as SHA-256 demands. A sequence's digests stand in one row, 20 bytes a turn.
    An empty table gives no row.
    """
    spark = found.sparkSession
    ship(spark)
    block, last_items, fan = block or BLOCK, last_items or LAST_ITEMS, fan or FAN
    alike = found.groupBy("key", "words", F.shiftright("conv_id", ID_BITS).alias("span")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    ids = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    alike = alike.select("key", "words", "span", F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("low"), ids.alias("ids"))
    alike = store(alike, "sequences")
    blocks = max(spark.sparkContext.defaultParallelism, -(-alike.count() // block))
    ordered = alike.repartitionByRange(blocks, "key").sortWithinPartitions("key", "span")
    level = store(ordered.select("key", "words", "n", "low", "ids").mapInArrow(_first, _FOUND), "trie")
    chains = level.where(F.col("unit").isNull())
    while True:
        items = level.where(F.col("unit").isNotNull()).select(*_ITEM)
        if items.count() <= last_items:
            break
        upper = F.expr(f"unit div {fan}")
        items = items.repartition(upper).sortWithinPartitions(upper, "unit", "seq")
        level = store(items.mapInArrow(_again(fan), _FOUND), "trie")
        chains = chains.unionByName(level.where(F.col("unit").isNull()))
    last = items.repartition(1).sortWithinPartitions("unit", "seq").mapInArrow(_again(None), _FOUND)
    chains = store(chains.unionByName(last).select("parent", "node", "start", "n", "low", "total", "fresh", "leaves", "ends", "children", "before"), "chains")
    tops = chains.where(F.col("node").isNotNull()).select(F.col("node").alias("parent"), F.col("low").alias("above"), F.col("children").alias("rows"))
    chains = attach(chains, tops, ["parent"], [F.col("low"), F.col("start")], "left", "rows")
    nodes = chains.select("*", F.posexplode("before").alias("at", "words_above"))
    bottom = F.col("at") == F.size("before") - 1
    return nodes.select(
        F.col("low").alias("conv_id"),
        (F.col("start") + F.col("at")).cast("long").alias("depth"),
        F.when(F.col("at") > 0, F.col("low")).otherwise(F.col("above")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(bottom, F.col("children")).otherwise(F.lit(1).cast("long")).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("total") - F.col("fresh") - (F.col("n") - 1) * F.col("words_above")).alias("saved_tokens"),
        F.coalesce(F.when(bottom, F.col("ends")), F.lit(_NO_ENDS)).alias("ends_sha256"),
    )


def prefix_trie(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    rebuild: bool = False,
) -> DataFrame:
    """The nodes of ``trie`` for a table of turns; ``rebuild``: of the conversations as ``rebuilt`` puts them together.

    Turns go by number (null first), ties by digest of role and text; rows that repeat are turns of their own. A null role or text is ''. Rows without
    conv_id belong to no conversation. Texts of any length count whole and only their digests travel. An empty table gives no row. Further
    columns are not read, whatever their names.
    """
    rows = turns(conversations, conv_col, turn_col, role_col, text_col)
    return trie(rebuilt(rows) if rebuild else sequences(rows))


def trie_sql() -> str:
    """The trie of rebuilt conversations in SQL for DuckDB: every prefix of every conversation, level by level."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS ks,
  list(len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) ORDER BY turn NULLS FIRST, k) AS ws FROM t GROUP BY conv_id),
crc AS (SELECT conv_id, (list_reduce([4294967295::BIGINT] || list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT),
  lambda c, b: list_reduce([xor(c, b)] || list_transform(range(8), lambda i: 0::BIGINT), lambda x, i: {step})) & 3) AS low FROM o),
h AS (SELECT conv_id, xor(low, 3) AS h FROM crc),
r AS (SELECT o.conv_id, coalesce(b.ks[1:h], []) || o.ks[h + 1:] AS ks, coalesce(b.ws[1:h], []) || o.ws[h + 1:] AS ws
  FROM o JOIN h USING (conv_id) LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 20),
p AS (SELECT conv_id, d, array_to_string(ks[1:d], ',') AS key, array_to_string(ks[1:d - 1], ',') AS above, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, d = len(ks) AS last
  FROM r, LATERAL (SELECT unnest(range(0, len(ks) + 1)) AS d)),
n AS (SELECT d, key, any_value(above) AS above, any_value(w) AS w, min(conv_id) AS low, count(*) AS n,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends FROM p GROUP BY d, key),
c AS (SELECT d - 1 AS d, above AS key, count(*) AS c FROM n WHERE d > 0 GROUP BY ALL),
under AS (SELECT DISTINCT p.d, p.key, q.d AS d2, q.key AS key2 FROM p JOIN p q ON p.conv_id = q.conv_id AND q.d >= p.d),
s AS (SELECT under.d, under.key, count(*) FILTER (c.c IS NULL) AS leaves, sum((n.n - 1) * n.w) AS saved
  FROM under JOIN n ON n.d = d2 AND n.key = key2 LEFT JOIN c ON c.d = d2 AND c.key = key2 GROUP BY ALL)
SELECT n.low AS conv_id, n.d AS depth, u.low AS parent_conv_id, n.n AS n_convs, coalesce(c.c, 0) AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN s ON s.d = n.d AND s.key = n.key LEFT JOIN c ON c.d = n.d AND c.key = n.key LEFT JOIN n u ON n.d > 0 AND u.d = n.d - 1 AND u.key = n.above"""
