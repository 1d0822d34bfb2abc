"""Exact Jaccard join of documents' word n-gram sets, by pivots and triangle windows.

1. Equal sets are one class; only the class with the smallest id as representative goes on.
2. Routing. A pair within the radius differs in at most D shingles, a number that follows
   from the sizes. The shingles are dealt by hash into more than D parts, so such a pair
   has equal parts. A part's members are one entry; of all sets with an equal entry the
   one with the smallest id is the pivot and every other joins the pivot's region. A set
   belongs to all regions whose pivot it may share a cell with: the boundary copies.
3. In a region, members within the radius link to the pivot; the others are open. Blocks of
   members join exactly: each open member is a further pivot whose distances, with the triangle
   inequality, say who is left to be compared.
4. A region of several blocks goes on with the labels of the components found so far, as only
   members with different labels need comparing. Further pivots cut it into Voronoi
   regions: a member's home is its nearest pivot, and it is also put, as a boundary copy, into every
   region whose pivot is at most two radii farther. These join in the same way, recursively. Distances
   here are those between sketches, a metric that never exceeds the difference of the sets.
   Where pivots do not separate the members, pairs of blocks are compared; members with
   a common label are gathered in blocks of their own, which never meet.
5. Links make components. A block sends no more links than it has members.

Global Voronoi regions over corpus pivots would not prune here: distances between
unrelated texts crowd at 1, so every window would hold every document. Routing by equal
parts is the same argument in a projected space, where the radius is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import words as W
from gridloom.llm.components import components
from gridloom.llm.frames import as_bytes, attach, pieces, small
from gridloom.session import ship, store

#: Members, and shingles, of a block of a region.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Further pivots of a region, and the bytes of all their sketches up to which these are broadcast.
PIVOTS, BROADCAST_BYTES = 16, 32 << 20
#: Ids (8 bytes each) up to which they are broadcast; beyond, texts are shuffled by id.
BROADCAST_IDS = 1_000_000
#: Ratio of the largest to the smallest size of a size class.
CLASS_RATIO = 1.5
#: Sets of an entry beyond which it is common, and members of a region for each copy of its pivot.
COMMON, COPY_MEMBERS = 64, 1024
#: Entries that a task gathers before it sends them.
GATHER = 1 << 19


class Radius:
    """Sets link when den * intersection >= num * union."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def linked(self, inter: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.den * inter >= self.num * (a + b - inter)

    def most(self, size: int) -> int:
        """The largest size that a partner of a set of ``size`` can have."""
        return size * self.den // self.num

    @lru_cache(maxsize=None)
    def classes(self, upto: int) -> list[int]:
        """The largest size of each size class."""
        ends = [1]
        while ends[-1] < upto:
            ends.append(max(ends[-1] + 1, int(ends[-1] * CLASS_RATIO)))
        return ends

    def difference(self, size):
        """The most shingles in which two sets within the radius differ, by the sum of their sizes."""
        return size * (self.den - self.num) // (self.den + self.num)

    @lru_cache(maxsize=None)
    def parts(self, end: int) -> tuple[int, int, int]:
        """D, the slack for common entries, and the number of parts, for pairs whose larger set has at most ``end`` shingles.

        There are enough parts that even the class's smallest sets have D + 1 + slack parts that
        are not empty, but for rare cases.
        """
        differ = self.difference(2 * end)
        least = max(1, int(end / CLASS_RATIO))
        common = min(2 + differ // 3, max(0, least - differ - 2))
        need = parts = differ + 1 + common
        while parts < 16 * least:
            empty = (1 - 1 / parts) ** least
            if parts * (1 - empty) - 2 * (parts * empty * (1 - empty)) ** 0.5 >= need:
                break
            parts += 1 + parts // 16
        return differ, common, parts


def class_hash(h: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of shingle hashes."""
    mixed = W.mix(h + W.GOLDEN)
    return int(mixed.sum(dtype=np.uint64)), int((mixed ^ (h * W.MIX_2)).sum(dtype=np.uint64))


def entries(h: np.ndarray, radius: Radius) -> tuple[np.ndarray, np.ndarray]:
    """Entries of a set, for its size class and, where a partner may be there, the next ones; for each its class's slack for common ones.

    A set sends its D + 1 + slack largest parts (of equally large ones those with the largest keys).
    Of two sets, the one whose smallest part sent is larger differs from the other in at
    most D of those, and the other one sends all that are equal: 1 + slack at least.
    """
    n = len(h)
    none = np.empty(0, np.uint64), np.empty(0, np.int32)
    if n == 0 or radius.num * (n + 1) > radius.den * n:
        return none  # only equal sets can link
    ends = radius.classes(1 << max(4, radius.most(n).bit_length()))
    keys, allow = [], []
    mixed = W.mix(h ^ W.GOLDEN)
    halves = (mixed & np.uint64(0xFFFFFFFF)).astype(float), (mixed >> np.uint64(32)).astype(float)
    for c in range(np.searchsorted(ends, n), np.searchsorted(ends, radius.most(n)) + 1):
        differ, common, parts = radius.parts(ends[c])
        if not differ:
            continue
        part = ((h >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
        lo, hi = np.bincount(part, halves[0], parts), np.bincount(part, halves[1], parts)
        sizes = np.bincount(part, minlength=parts)
        salt = np.arange(parts, dtype=np.uint64) * W.MIX_1 + np.uint64((int(c) * int(W.GOLDEN)) & 0xFFFFFFFFFFFFFFFF)
        key = W.mix(lo.astype(np.uint64) + (hi.astype(np.uint64) << np.uint64(32)) + salt)
        order = (sizes.astype(np.uint64) << np.uint64(40)) | (key >> np.uint64(24))
        out = parts - (differ + 1 + common)
        keys.append(key[order >= np.partition(order, out)[out]] if out > 0 else key)
        allow.append(np.full(len(keys[-1]), common, np.int32))
    return (np.concatenate(keys), np.concatenate(allow)) if keys else none


def sketch(h: np.ndarray) -> bytes:
    """Parities: bit i tells whether an odd number of shingles hash to i. About one bit a shingle.

    Two sets' sketches differ in no more bits than the sets in shingles.
    """
    bits = max(64, 1 << (len(h) - 1).bit_length()) if len(h) else 64
    place = (W.mix(h + W.MIX_2) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(rows: np.ndarray, width: int) -> np.ndarray:
    """Sketches of half as many bits, until they have ``width`` words."""
    while rows.shape[1] > width:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def may_link(a: list[bytes], b: list[bytes], n: np.ndarray, m: np.ndarray, radius: Radius) -> np.ndarray:
    """False for pairs (of equal places in a and b) whose sketches or sizes forbid a link."""
    most = radius.difference(n + m)
    maybe = np.abs(n - m) <= most
    widths = np.array([[len(x) for x in a], [len(x) for x in b]]).reshape(2, -1)
    for wa, wb in np.unique(widths[:, maybe], axis=1).T.tolist():
        own = np.flatnonzero(maybe & (widths[0] == wa) & (widths[1] == wb))
        x, y = (np.frombuffer(b"".join([side[i] for i in own]), np.uint64).reshape(len(own), -1) for side in (a, b))
        width = min(x.shape[1], y.shape[1])
        maybe[own] = np.bitwise_count(_folded(x, width) ^ _folded(y, width)).sum(axis=1) <= most[own]
    return maybe


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 512):
            sizes, first, second, bits = [], [], [], []
            for text in as_bytes(batch["text"]):
                h = W.shingles(W.hashed((text or b"").lower().split()), n)
                a, b = class_hash(h)
                sizes.append(len(h))
                first.append(a)
                second.append(b)
                bits.append(sketch(h))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"],
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(first, np.uint64).view(np.int64)),
                    pa.array(np.array(second, np.uint64).view(np.int64)),
                    pa.array(bits, pa.binary()),
                ],
                ["id", "size", "h1", "h2", "bits"],
            )

    return run


_SETS = "id long, size long, h1 long, h2 long, bits binary"


_POSTING = ["key", "id", "allow", "behind", "entry"]


def _postings(n: int, radius: Radius):
    """Texts -> rows (key, id, allow, behind, entry).

    Of equal sets in a task, the first one speaks. An entry goes out once from a task, for
    its smallest id there, which says whether others stand behind it; these go out
    under a key of their own, so that a common entry sends no more rows to one place than
    there are tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def out() -> Iterator[pa.RecordBatch]:
            key, who, allow = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((who, key))
            key, who, allow = key[order], who[order], allow[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            behind = np.append(~new[1:], False)
            spread = W.mix(who.view(np.uint64) * W.GOLDEN + key)
            columns = [
                np.where(new, key, spread).view(np.int64),
                who,
                allow,
                np.where(new, behind, True),
                np.where(new, np.uint64(0), key).view(np.int64),
            ]
            whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns[:-1]] + [pa.array(columns[-1], mask=new)], _POSTING)
            yield from (whole.slice(at, 1 << 16) for at in range(0, len(key), 1 << 16))

        for batch in pieces(batches, 512):
            for who, text in zip(batch["id"].to_pylist(), as_bytes(batch["text"]), strict=True):
                h = W.shingles(W.hashed((text or b"").lower().split()), n)
                whole = class_hash(h)
                if whole in seen or not len(h):
                    continue
                seen.add(whole)
                key, allow = entries(h, radius)
                held.append((key, np.full(len(key), who, np.int64), allow))
                size += len(key)
                if size > GATHER:
                    yield from out()
                    held, size = [], 0
        if size:
            yield from out()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, id) -> (entry, id, allow) of the entries that several sets have."""
    last: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, who, allow, behind = (batch[c].to_numpy(zero_copy_only=False) for c in _POSTING[:-1])
        waits = batch["entry"].is_null().to_numpy(zero_copy_only=False)
        entry = batch["entry"].fill_null(0).to_numpy(zero_copy_only=False)
        parts = [[entry[~waits], who[~waits], allow[~waits]]]
        here = [x[waits] for x in (key, who, allow, behind)]
        if len(here[0]):
            if last is not None:
                here = [np.concatenate([a, b]) for a, b in zip(last, here, strict=True)]
            same = here[0][1:] == here[0][:-1]
            shared = here[3].astype(bool) | np.append(same, False) | np.concatenate([[False], same])
            # The last row waits for the next batch, with what is known of it.
            last = [x[-1:] for x in here]
            last[3] = shared[-1:]
            parts.append([x[:-1][shared[:-1]] for x in here[:3]])
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["entry", "id", "allow"])
    if last is not None and last[3][0]:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in last[:3]], ["entry", "id", "allow"])


def region_members(texts: DataFrame, n: int, radius: Radius) -> DataFrame:
    """(pivot, id): the members of each region, without the pivot itself.

    Entries of more than COMMON sets are common (a passage or line that many texts share
    makes such). A pair within the radius has an entry in common that isn't, unless both sets
    have more common ones than the slack; only such sets meet in common entries.
    """
    def meeting(rows: DataFrame, facts: DataFrame, how: str) -> DataFrame:
        """Rows joined to facts of common entries; a common entry's rows never go to one task."""
        if facts.count() <= BROADCAST_IDS:
            return rows.join(F.broadcast(facts), "entry", how)
        return attach(rows, facts, ["entry"], [F.col("id")], how, "n")

    postings = texts.mapInArrow(_postings(n, radius), "key long, id long, allow int, behind boolean, entry long")
    met = store(postings.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_meet, "entry long, id long, allow int"), "met")
    common = store(met.groupBy("entry").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COMMON), "common")
    usual = meeting(met, common, "left_anti").select("entry", "id")
    hot = meeting(met, common, "left_semi")
    full = hot.groupBy("id", "allow").agg(F.count(F.lit(1)).alias("n")).where("n > allow").select("id", "allow")
    hot = store(hot.join(full, ["id", "allow"], "left_semi").select("entry", "id"), "common-members")
    firsts = usual.groupBy("entry").agg(F.min("id").alias("pivot"))
    hot_firsts = store(hot.groupBy("entry").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("n")), "common-pivots")
    members = usual.join(firsts, "entry").unionByName(meeting(hot, hot_firsts, "inner").drop("n"))
    return store(members.where("pivot <> id").select("pivot", "id").distinct(), "regions")


def _hash_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 128):
            sets = [np.sort(W.signed(W.shingles(W.hashed((t or b"").lower().split()), n))) for t in as_bytes(batch["text"])]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.ListArray.from_arrays(pa.array(ends), flat)], ["id", "hashes"])

    return run


def _common(one: np.ndarray, flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sizes of the intersections of a sorted set with ``n`` sets, laid end to end."""
    at = np.searchsorted(one, flat)
    at[at == len(one)] = 0
    return np.bincount(owner[one[at] == flat], minlength=n)


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in sets])
    return np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), sizes


def _maybe(radius: Radius):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members beside their pivot's sketch -> whether they may link."""
        for batch in pieces(batches, 4096):
            got = may_link(
                batch["bits"].to_pylist(),
                batch["pivot_bits"].to_pylist(),
                batch["size"].to_numpy(),
                batch["pivot_size"].to_numpy(),
                radius,
            )
            yield pa.RecordBatch.from_arrays([batch["pivot"], batch["id"], pa.array(got)], ["pivot", "id", "maybe"])

    return run


def _to_pivot(radius: Radius):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members beside their pivot's set -> whether they link, and their distance."""
        for batch in pieces(batches, 1024):
            a, b = batch["hashes"], batch["pivot_hashes"]
            inter = np.array(
                [len(np.intersect1d(x.values.to_numpy(), y.values.to_numpy(), assume_unique=True)) for x, y in zip(a, b, strict=True)],
                np.int64,
            )
            n, m = (c.value_lengths().to_numpy().astype(np.int64) for c in (a, b))
            yield pa.RecordBatch.from_arrays(
                [batch["pivot"], batch["id"], pa.array(radius.linked(inter, n, m)), pa.array(1 - inter / (n + m - inter))],
                ["pivot", "id", "linked", "distance"],
            )

    return run


_CELL = ["region", "i", "j"]
_CELL_TYPES = [pa.int64(), pa.int64(), pa.int64()]


def _near(radius: Radius):
    def run(table: pa.Table) -> pa.Table:
        """The members of a block or two, by sketches -> those that may link with one of another label."""
        ids, home, label = (table[c].to_numpy(zero_copy_only=False) for c in ("id", "home", "label"))
        sizes, bits = table["size"].to_numpy(), table["bits"].to_pylist()
        lengths = np.array([len(x) for x in bits])
        use = np.zeros(len(ids), bool)
        for width in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == width)
            rows = {}  # the sketches of this width, folded
            rows[width] = np.frombuffer(b"".join([bits[i] for i in own]), np.uint64).reshape(len(own), -1)
            for i in np.flatnonzero(home):
                low = min(width, lengths[i])
                if low not in rows:
                    rows[low] = _folded(rows[width], low // 8)
                most = radius.difference(sizes[own] + sizes[i])
                pick = np.flatnonzero((np.abs(sizes[own] - sizes[i]) <= most) & (label[own] != label[i]))
                if len(pick):
                    one = _folded(np.frombuffer(bits[i], np.uint64)[None, :], low // 8)
                    near = np.bitwise_count(rows[low][pick] ^ one).sum(axis=1) <= most[pick]
                    if near.any():
                        use[own[pick[near]]] = use[i] = True
        got = pa.array(np.flatnonzero(use))
        return table.select([*_CELL, "id", "home", "label", "distance"]).take(got)

    return run


def block_links(
    ids: np.ndarray,
    sets: list[np.ndarray],
    dist: np.ndarray,
    open_: np.ndarray,
    label: np.ndarray,
    radius: Radius,
) -> list[tuple[int, int]]:
    """Links among members of which one is open (not linked to the pivot), by recursion on pivots.

    ``dist``: distances to the region's pivot. Takes an open member as the next pivot,
    finds its distances inside the triangle window, links those within the radius, and
    goes on with the rest of the open members. Members with one ``label`` are connected
    already, so there are fewer links than labels.
    """
    r = 1 - radius.num / radius.den + 1e-9
    flat, owner, sizes = _flat(sets)
    known = [dist]
    links: list[tuple[int, int]] = []
    root = np.unique(label, return_inverse=True)[1]
    for i in np.flatnonzero(open_):
        window = np.ones(len(ids), bool)
        for d in known:
            window &= ~(np.abs(d - d[i]) > r)  # NaN: not known, stays
        window &= root != root[i]
        window &= (radius.num * np.maximum(sizes, sizes[i])) <= radius.den * np.minimum(sizes, sizes[i])
        if not window.any():
            continue
        pick = np.flatnonzero(window)
        use = window[owner]
        inter = np.zeros(len(ids), np.int64)
        inter[pick] = _common(sets[i], flat[use], owner[use], len(ids))[pick]
        hit = pick[radius.linked(inter[pick], sizes[pick], sizes[i])]
        if len(pick) > len(ids) // 2 and len(known) < 8:
            d = np.full(len(ids), np.nan)
            d[pick] = 1 - inter[pick] / (sizes[pick] + sizes[i] - inter[pick])
            d[i] = 0
            known.append(d)
        for j in hit:
            if root[j] != root[i]:
                links.append((int(ids[i]), int(ids[j])))
                root[root == root[j]] = root[i]
    return links


def _within(radius: Radius):
    def run(table: pa.Table) -> pa.Table:
        """The members of a block or two -> links that connect what is linked there."""
        ids, home, label = (table[c].to_numpy(zero_copy_only=False) for c in ("id", "home", "label"))
        hashes = table["hashes"].combine_chunks()
        dist = table["distance"].to_numpy(zero_copy_only=False).astype(float)
        links = block_links(ids, [x.values.to_numpy() for x in hashes], dist, home, label, radius)
        return pa.table({"u": pa.array([x[0] for x in links], pa.int64()), "v": pa.array([x[1] for x in links], pa.int64())})

    return run


def _homes(radius: Radius, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members beside their region's further pivots -> the smaller regions they belong to.

        Let a's nearest pivot be p, and b within the radius of a, so that their sketches differ in at
        most r. Then d(b, p) <= d(a, p) + r <= d(a, q) + r <= d(b, q) + 2r for each pivot q.
        """
        for batch in pieces(batches, 1024):
            region = batch["region"].to_numpy()
            rows = []
            for one in np.unique(region).tolist():
                own = np.flatnonzero(region == one)
                pivots = batch["pivots"][int(own[0])].as_py()
                bits = [batch["bits"][int(i)].as_py() for i in own]
                width = batch["width"][int(own[0])].as_py() // 8
                fold = lambda x, width=width: _folded(np.frombuffer(x, np.uint64)[None, :], width)
                mine, theirs = np.concatenate([fold(x) for x in bits]), np.concatenate([fold(x) for x in pivots])
                far = np.stack([np.bitwise_count(mine ^ p).sum(axis=1, dtype=np.int64) for p in theirs], axis=1)
                size = batch["size"].to_numpy()[own]
                # The largest partner has size * den / num shingles.
                reach = size * (radius.den - radius.num) // radius.num
                nearest = far.argmin(axis=1)
                member, cell = np.nonzero(far <= (far.min(axis=1) + 2 * reach)[:, None])
                name = W.mix(np.full(len(cell), one, np.int64).view(np.uint64) * W.GOLDEN + (cell + (level << 16)).astype(np.uint64))
                rows.append((own[member], W.signed(name), cell == nearest[member]))
            at, name, nearest = (np.concatenate(x) for x in zip(*rows, strict=True))
            part = batch.take(pa.array(at))
            home = part["home"].to_numpy(zero_copy_only=False) & nearest
            yield pa.RecordBatch.from_arrays(
                [part["region"], pa.array(name), part["id"], pa.array(home), part["label"], part["distance"]],
                ["parent", *_MEMBER],
            )

    return run


_MEMBER = ["region", "id", "home", "label", "distance"]
_MEMBER_TYPES = "region long, id long, home boolean, label long, distance double"


def _fetch(texts: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The shingle sets of some documents, stored."""
    wanted = small(ids.distinct(), "wanted", BROADCAST_IDS)
    return store(texts.join(wanted, "id", "left_semi").mapInArrow(_hash_sets(n), "id long, hashes array<long>"), "shingles")


def region_links(texts: DataFrame, sets: DataFrame, regions: DataFrame, n: int, radius: Radius) -> DataFrame:
    """(u, v): links, enough of them to connect all that links connect.

    Sketches exclude most pairs before any set is fetched; the rest is decided on sets.
    """
    sketches = sets.where("id is not null").select("id", "size", "bits").dropDuplicates(["id"])
    # A pivot goes along with its members; in a large region it has copies.
    spread = store(regions.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / COPY_MEMBERS).cast("int").alias("copies")), "copies")
    large = small(spread.where("copies > 1"), "large", BROADCAST_IDS)
    copy = F.coalesce(F.pmod(F.xxhash64("id"), F.col("copies")).cast("int"), F.lit(0))
    copied = spread.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    place = lambda members: members.join(large, "pivot", "left").withColumn("copy", copy).drop("copies")
    pivots = copied.join(sketches, copied["pivot"] == sketches["id"]).select(
        "pivot",
        "copy",
        F.col("bits").alias("pivot_bits"),
        F.col("size").alias("pivot_size"),
    )
    beside = place(regions).join(sketches, "id").join(pivots, ["pivot", "copy"])
    maybe = store(
        beside.select("pivot", "id", "bits", "size", "pivot_bits", "pivot_size").mapInArrow(_maybe(radius), "pivot long, id long, maybe boolean"),
        "maybe",
    )
    near = maybe.where("maybe").select("pivot", "id")
    hashes = _fetch(texts, near.select("id").unionAll(near.select("pivot")), n)
    own = copied.join(hashes, copied["pivot"] == hashes["id"]).select("pivot", "copy", F.col("hashes").alias("pivot_hashes"))
    verified = place(near).join(hashes, "id").join(own, ["pivot", "copy"]).select("pivot", "id", "hashes", "pivot_hashes")
    told = store(verified.mapInArrow(_to_pivot(radius), "pivot long, id long, linked boolean, distance double"), "distances")
    direct = told.where("linked").select(F.col("id").alias("u"), F.col("pivot").alias("v"))
    # Regions in which some member is open and has another one to be compared with.
    opened = ~F.coalesce("linked", F.lit(False))
    state = maybe.select("pivot", "id").join(told, ["pivot", "id"], "left")
    state = state.select(
        F.col("pivot").alias("region"),
        "id",
        opened.alias("home"),
        F.when(opened, F.col("id")).otherwise(F.col("pivot")).alias("label"),
        "distance",
    )
    return direct.unionAll(_recurse(texts, sketches, direct, store(state, "state"), n, radius))


def _cells(texts: DataFrame, sketches: DataFrame, cells: DataFrame, n: int, radius: Radius) -> DataFrame:
    """(u, v): links between members (region, i, j, id, home, label, distance) that share region, i and j."""
    types = "region long, i long, j long, id long, home boolean, label long, distance double"
    near = store(cells.join(sketches, "id").groupBy(*_CELL).applyInArrow(_near(radius), types), "near")
    held = near.join(_fetch(texts, near.select("id"), n), "id")
    return store(held.groupBy(*_CELL).applyInArrow(_within(radius), "u long, v long"), "block-links")


def _sizes(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """region, n, blocks, width: regions in which something is left to compare."""
    held = members.join(sketches.select("id", "size", F.length("bits").alias("bytes")), "id")
    sums = held.groupBy("region").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("home").alias("home"),
        F.sum("size").alias("shingles"),
        F.min("bytes").alias("width"),
        (F.min("label") != F.max("label")).alias("mixed"),
    )
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    return store(sums.where("home and mixed").select("region", "n", blocks.alias("blocks"), "width"), "sizes")


def _block(blocks: str, level: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(level)), F.col(blocks)).cast("long")


def _recurse(texts: DataFrame, sketches: DataFrame, links: DataFrame, members: DataFrame, n: int, radius: Radius) -> DataFrame:
    """(u, v): links in regions (region, id, home, label, distance); one of two members must be at home."""
    out = links.limit(0)
    level = 0
    while True:
        sizes = _sizes(members, sketches)
        if not sizes.count():
            return out
        held = attach(members, sizes, ["region"], [F.col("id")], "inner", "n")
        own = _block("blocks", level)
        out = out.unionAll(_cells(
            texts,
            sketches,
            held.withColumn("i", own).withColumn("j", own).select(*_CELL, "id", "home", "label", "distance"),
            n,
            radius,
        ))
        large = sizes.where("blocks > 1")
        if not large.count():
            return out
        # Only members of different components need comparing now.
        held = attach(members, large.drop("blocks", "width"), ["region"], [F.col("id")], "inner", "n")
        label = components(links.unionAll(out)).withColumnRenamed("node", "id")
        held = held.select("region", "id", "home", "distance").join(label, "id", "left")
        members = store(held.select("region", "id", "home", F.coalesce("component", "id").alias("label"), "distance"), "labelled")
        sizes = _sizes(members, sketches)
        parts = _voronoi(sketches, members, sizes, radius, level)
        # Further pivots help where they halve the pairs; elsewhere pairs of blocks are compared.
        square = parts.groupBy("parent", "region").agg(F.count(F.lit(1)).alias("m")).groupBy("parent").agg(F.sum(F.col("m") * F.col("m")).alias("pairs"))
        helped = square.join(sizes, square["parent"] == sizes["region"]).where(F.col("pairs") * 2 < F.col("n") * F.col("n")).select("region", "n")
        helped = store(helped, "split")
        rest = sizes.join(helped, "region", "left_anti")
        if rest.count():
            out = out.unionAll(_cells(texts, sketches, _grid(members, rest), n, radius))
        if not helped.count():
            return out
        chosen = helped.select(F.col("region").alias("parent"), "n")
        members = store(attach(parts, chosen, ["parent"], [F.col("id")], "inner", "n").select(*_MEMBER), "members")
        level += 1


def _voronoi(sketches: DataFrame, members: DataFrame, sizes: DataFrame, radius: Radius, level: int) -> DataFrame:
    """(parent, region, id, home, label, distance): members in the Voronoi regions of further pivots."""
    held = attach(members, sizes.drop("blocks"), ["region"], [F.col("id")], "inner", "n").join(sketches, "id")
    slot = F.pmod(F.xxhash64("id", F.lit(level + 1)), F.lit(PIVOTS))
    picked = held.where("home").groupBy("region", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("id", F.lit(-1 - level)), "bits")).alias("first"))
    pivots = store(
        picked.groupBy("region").agg(F.collect_list("first.bits").alias("pivots")).join(sizes.select("region", "n"), "region"),
        "pivots",
    )
    whole = pivots.agg(F.sum(F.expr("aggregate(pivots, 0L, (s, x) -> s + length(x))"))).first()[0] or 0
    if whole <= BROADCAST_BYTES:
        beside = held.drop("n").join(F.broadcast(pivots), "region")
    else:
        beside = attach(held.drop("n"), pivots, ["region"], [F.col("id")], "inner", "n")
    beside = beside.select(*_MEMBER, "size", "bits", "width", "pivots")
    return store(beside.mapInArrow(_homes(radius, level), f"parent long, {_MEMBER_TYPES}"), "voronoi")


def _grid(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members (region, i, j, id, home, label, distance) in pairs of blocks i <= j, but where both hold one and the same label."""
    held = attach(
        members,
        sizes.select("region", "n", (F.col("n") / F.col("blocks")).alias("each")),
        ["region"],
        [F.col("id")],
        "inner",
        "n",
    )
    labels = store(held.groupBy("region", "label").agg(F.count(F.lit(1)).alias("n"), F.first("each").alias("each")), "labels")
    # A label of a block or more has blocks of its own, the others share blocks.
    alone = labels.where("n >= each").select("region", "label", F.ceil(F.col("n") / F.col("each")).cast("int").alias("own"), "n")
    shared = labels.where("n < each").groupBy("region").agg(
        F.ceil(F.sum("n") / F.first("each")).cast("int").alias("shared"),
        F.sum("n").alias("n"),
    )
    held = attach(held.drop("n"), alone, ["region", "label"], [F.col("id")], "left", "n").drop("n")
    held = attach(held, shared, ["region"], [F.col("id")], "left", "n")
    single = F.col("own").isNotNull()
    block = F.when(single, F.xxhash64("label", _block("own", -2))).otherwise(_block("shared", -2))
    held = store(held.select(*_MEMBER, F.when(single, F.col("label")).alias("only"), block.alias("block")), "blocks")
    blocks = store(held.groupBy("region", "only", "block").agg(F.count(F.lit(1)).alias("n")).drop("n"), "block-names")
    a, b = blocks.select(
        "region",
        F.col("only").alias("p"),
        F.col("block").alias("i"),
    ), blocks.select("region", F.col("only").alias("q"), F.col("block").alias("j"))
    pairs = store(
        a.join(b, "region").where("i < j or (i = j and p is null)").where("p is null or q is null or p <> q").select(*_CELL),
        "block-pairs",
    )
    first = pairs.join(held.withColumnRenamed("block", "i"), ["region", "i"])
    second = pairs.where("i < j").join(held.withColumnRenamed("block", "j"), ["region", "j"])
    return first.select(*_CELL, "id", "home", "label", "distance").unionAll(second.select(*_CELL, "id", "home", "label", "distance"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents link when ``den`` * intersection >= ``num`` * union of their n-word shingle
    sets (A-Z in lower case, words between ASCII white space; fewer than n words: the whole
    sequence). Null, empty and wordless texts have an empty set and link with nothing. The
    component is the smallest id reachable, itself included; kept: the row's id is that id. Ids
    tell documents apart: rows that repeat an id share a component, and if their texts
    differ the links of any of these may count. A null id never links: its component is null
    and it is kept. Other columns are not read. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    radius = Radius(num, den)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = store(rows.mapInArrow(_sets(n), _SETS), "sets")
    texts = rows.where("id is not null")
    links = region_links(texts, sets, region_members(texts, n, radius), n, radius)
    full = sets.where("size > 0 and id is not null")
    classes = full.groupBy("h1", "h2", "size").agg(F.min("id").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same = attach(full, classes, ["h1", "h2", "size"], [F.col("id")], "inner", "n").select(F.col("id").alias("u"), "v")
    found = components(links.unionAll(same)).withColumnRenamed("node", "id")
    low = F.coalesce(F.col("component"), F.col("id"))
    out = sets.join(found, "id", "left")
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("size").alias("n_shingles"),
        low.alias("component_id"),
        low.eqNullSafe(F.col("id")).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each group of linked ones: that with the smallest id."""
    marked = join(docs, id_col, text_col, n, num, den)
    gone = small(marked.where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "dropped", BROADCAST_IDS)
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
