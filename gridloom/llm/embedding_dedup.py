"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A hash rotates a vector by three rounds of random signs and a Hadamard transform; its
value is the axis, with its sign, that lies nearest. Several hashes make a table's bucket;
besides its own bucket a vector also takes the buckets that lie next nearest (multiprobe). Every
pair that meets in a bucket is verified by its cosine in double precision.

Pairs are never rows: a block of a bucket yields, for each vector, the number of its links
there and a spanning forest. A pair that meets in several buckets counts in the one
with the smallest key. Equal vectors are one class with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.components import components, local_stars
from gridloom.llm.frames import attach
from gridloom.llm.words import GOLDEN, mix
from gridloom.session import ship, store

#: Tables and buckets of a vector in each; hashes of a table by the number of vectors.
TABLES, PROBES, SEED = 8, 3, 20240
#: Vectors of a block of a bucket.
BLOCK = 512


def hashes_for(rows: int, dims: int) -> int:
    """Hashes of a table so that there are about as many buckets as vectors."""
    return max(1, int(np.ceil(np.log(max(rows, 2)) / np.log(2 * max(dims, 2)))))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of rows; their length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
    return x.reshape(n, d) / np.sqrt(d)


def bucket_keys(
    vectors: np.ndarray,
    group: np.ndarray,
    hashes: int,
    tables: int = TABLES,
    probes: int = PROBES,
    seed: int = SEED,
) -> np.ndarray:
    """[vector, table * probe]: keys of the buckets of unit vectors, told apart by ``group``."""
    n, dims = vectors.shape
    wide = 1 << max(1, int(dims - 1).bit_length())
    padded = np.zeros((n, wide))
    padded[:, :dims] = vectors
    rng = np.random.default_rng([seed, dims])
    out = np.empty((n, tables, probes), np.uint64)
    for t in range(tables):
        first, second, loss = (np.empty((n, hashes), x) for x in (np.int64, np.int64, float))
        for k in range(hashes):
            x = padded
            for _ in range(3):
                x = hadamard(x * rng.choice([-1.0, 1.0], wide))
            size = np.abs(x)
            top = np.argpartition(-size, 1, axis=1)[:, :2]
            order = np.take_along_axis(size, top, 1).argsort(axis=1)[:, ::-1]
            top = np.take_along_axis(top, order, 1)
            value = 2 * top + (np.take_along_axis(x, top, 1) > 0)
            first[:, k], second[:, k] = value[:, 0], value[:, 1]
            both = np.take_along_axis(size, top, 1)
            loss[:, k] = both[:, 0] - both[:, 1]
        # Own bucket, then for the hashes of least loss their second value.
        swaps = np.argsort(loss, axis=1)
        for p in range(probes):
            value = first.copy()
            if p:
                # p in binary names the hashes, by rising loss, that take their second value.
                for bit in range(hashes):
                    if p >> bit & 1:
                        np.put_along_axis(value, swaps[:, bit : bit + 1], np.take_along_axis(second, swaps[:, bit : bit + 1], 1), 1)
            key = group + np.uint64((t + 1) * int(GOLDEN) & (1 << 64) - 1)
            for k in range(hashes):
                key = mix(key + value[:, k].astype(np.uint64) + np.uint64(k + 1))
            out[:, t, p] = key
    return out.reshape(n, -1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _keys(hashes: dict[int, int], tables: int, probes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dims"].to_numpy()
            for d in np.unique(dims).tolist():
                part = pa.Table.from_batches([batch]).filter(pa.array(dims == d)).combine_chunks()
                x = _matrix(part["vector"].combine_chunks())
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                group = mix(part["label"].to_numpy().astype(np.int64).view(np.uint64) * GOLDEN + np.uint64(d))
                keys = bucket_keys(x, group, hashes[d], tables, probes, seed).view(np.int64)
                ends = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        part["id"].combine_chunks(),
                        part["n"].combine_chunks(),
                        part["vector"].combine_chunks(),
                        pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1))),
                    ],
                    ["id", "n", "vector", "keys"],
                )

    return run


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal ``names``, from rows sorted by them."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        change = np.zeros(table.num_rows - 1, bool)
        for name in names:
            column = table[name].to_numpy()
            change |= column[1:] != column[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield table.slice(a, b - a)
        rest = table.slice(cuts[-1])
    if rest is not None:
        yield rest


def _links(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Block pairs of buckets -> (u, v, n): n more links for u (v null), or an edge (n null)."""
        us, vs, ns, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            u, v, n = np.concatenate(us), np.concatenate(vs), np.concatenate(ns)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v, mask=n > 0), pa.array(n, mask=n == 0)], ["u", "v", "n"])

        for table in _grouped(batches, ["key", "i", "j"]):
            ids = table["id"].to_numpy()
            if len(ids) < 2:
                continue
            key, i, j = (table[c][0].as_py() for c in ("key", "i", "j"))
            own = table["own"].to_numpy()
            left, right = (np.flatnonzero(own == i), np.flatnonzero(own == j))
            x = _matrix(table["vector"].combine_chunks())
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            near = x[left] @ x[right].T >= threshold
            a, b = np.nonzero(near)
            a, b = left[a], right[b]
            ordered = ids[a] < ids[b] if i == j else a != b
            a, b = a[ordered], b[ordered]
            if not len(a):
                continue
            keys = _matrix_long(table["keys"].combine_chunks())
            some = np.unique(np.concatenate([a, b]))
            values, counts = np.unique(keys[some], return_counts=True)
            values = values[(counts > 1) & (values < key)]
            if len(values):  # pairs that met in a smaller bucket count there
                held = np.zeros((len(ids), len(values)), np.float32)
                at = np.searchsorted(values, keys[some])
                at[at == len(values)] = 0
                row, col = np.nonzero(values[at] == keys[some])
                held[some[row], at[row, col]] = 1
                met = (held @ held.T > 0)[a, b]
                a, b = a[~met], b[~met]
                if not len(a):
                    continue
            weight = table["n"].to_numpy()
            links = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
            got = np.flatnonzero(links)
            star_u, star_v = local_stars(ids[a], ids[b])
            us += [ids[got], star_u]
            vs += [np.zeros(len(got), np.int64), star_v]
            ns += [links[got].astype(np.int64), np.zeros(len(star_u), np.int64)]
            size += len(got) + len(star_u)
            if size > 100_000:
                yield out()
                us, vs, ns, size = [], [], [], 0
        if size:
            yield out()

    return run


def _matrix_long(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    tables: int = TABLES,
    probes: int = PROBES,
    seed: int = SEED,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors are compared only when their labels are equal and not null and their lengths agree.
    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing; all others are compared, however large or small their components. Links are the pairs found with a cosine of ``threshold`` or more; equal
    vectors always link. Rows that repeat an id are one vector with their links together;
    a null id links with nothing and is kept. Other columns are not read. An empty
    table gives no rows.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vector_col).cast("array<double>").alias("vector"),
        F.xxhash64(F.col(label_col)).alias("label"),
        F.col(label_col).isNotNull().alias("known"),
    )
    norm = F.expr("aggregate(vector, 0D, (s, x) -> s + cast(x as double) * cast(x as double))")
    fit = F.col("known") & F.col("id").isNotNull() & F.expr("vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    # Where squares would over- or underflow, the largest component becomes 1.
    most = F.expr("array_max(transform(vector, x -> abs(x)))")
    scaled = F.when(norm.between(1e-200, 1e200), F.col("vector")).otherwise(F.transform("vector", lambda x: x / most))
    usable = rows.where(fit).where(most > 0).withColumn("vector", scaled)
    copies = usable.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("n"))
    classes = store(copies.select(F.col("rep").alias("id"), "n", "label", "vector", F.size("vector").alias("dims")), "classes")
    hashes = {r["dims"]: hashes_for(r["count"], r["dims"]) for r in classes.groupBy("dims").count().collect()}  # a row for each vector length
    keyed = store(
        classes.mapInArrow(
            _keys(hashes, tables, probes, seed),
            "id long, n long, vector array<double>, keys array<long>",
        ) if hashes else classes.selectExpr("id", "n", "vector", "array(0L) as keys").limit(0),
        "keys",
    )
    entries = keyed.select("id", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = store(entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    met = entries.join(sizes, "key").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks")).cast("int"))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", "id", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j")).join(keyed, "id")
    blocks = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = store(
        blocks.select("key", "i", "j", "own", "id", "n", "vector", "keys").mapInArrow(_links(threshold), "u long, v long, n long"),
        "links",
    )
    linked = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("links"))
    forest = components(found.where("v is not null").select("u", "v")).select(F.col("node").alias("rep"), "component")
    facts = copies.select("label", "vector", "rep", "n").join(linked, "rep", "left").join(forest, "rep", "left")
    facts = facts.select("label", "vector", "rep", "n", "links", "component").where("n > 1 or links is not null")
    members = attach(usable, facts.withColumn("_n", F.col("n")), ["label", "vector"], [F.col("id")], "inner", "_n")
    members = members.groupBy("id").agg(
        (F.sum(F.coalesce("links", F.lit(0)) + F.col("n") - 1)).alias("n_links"),
        F.min(F.coalesce("component", "rep")).alias("component"),
    )
    out = rows.select("id").join(members, "id", "left")
    low = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        low.alias("component_id"),
        low.eqNullSafe(F.col("id")).alias("kept"),
    )
