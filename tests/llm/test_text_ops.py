"""Text operators against brute force, and their edge cases."""

import bisect
import hashlib
import math
import random
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import exact_dedup, exchange, frames, jaccard_join, language_id, licences, mixing, packing, quality, substring_dedup
from gridloom.llm.components import components, local_stars
from gridloom.session import store

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=0, **extra):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts, first)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return df


def clashing(df):
    """More columns, with the names that operators use inside."""
    for name in ("id", "fp", "row", "_text", "_row", "copy_", "key", "draw", "n", "rep", "size", "kept", "bits", "start"):
        df = df.withColumn(name, F.lit("x"))
    return df


LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(60_000))
ODD = [None, "", "   ", "one", "one", "One", "a b", LONG, LONG, "tie", "tie", "<|endoftext|> x", "é, à.", "\t\nx\x0b"]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, (1 << 56) - 1), max_size=300))
def test_golomb_codes_round_trip(values):
    v = np.array(sorted(values), np.uint64) + np.uint64(7 << 56)
    data, k = exchange.encode(v, 7 << 56, 1 << 56)
    assert (exchange.decode(data, len(v), k, 7 << 56) == v).all()


def test_golomb_codes_are_short():
    v = np.unique(np.random.default_rng(1).integers(0, 1 << 56, 100_000, dtype=np.uint64))
    data, _ = exchange.encode(v, 0, 1 << 56)
    assert len(data) < 100_000 * (56 - 16.6 + 2) / 8 * 1.05


@pytest.mark.parametrize("block", [4, 65_536])
def test_exact_dedup_marks(spark, monkeypatch, block):
    monkeypatch.setattr(exact_dedup, "BLOCK_ROWS", block)
    df = clashing(docs(spark, ODD).unionByName(docs(spark, ["one", None], 3)).unionByName(docs(spark, ["lost", "one"]).withColumn("doc_id", F.lit(None).cast("long"))))
    rows = exact_dedup.mark_duplicates(df).collect()
    assert len(rows) == df.count()
    groups = defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        groups[r.text or ""].append(r.doc_id)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in rows:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    kept = defaultdict(int)
    for r in rows:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}
    left = exact_dedup.drop_duplicates(df)
    assert left.columns == df.columns and left.count() == len(groups)
    assert {r.text for r in left.collect()} in ({*groups} - {""} | {None}, {*groups}, {*groups} | {None})


def test_empty_tables(spark):
    none = docs(spark, ["x"]).limit(0)
    assert exact_dedup.mark_duplicates(none).count() == 0 == exact_dedup.drop_duplicates(none).count()
    assert jaccard_join.join(none).count() == 0 == jaccard_join.keep_one(none).count()
    assert mixing.mix(none).count() == 0
    assert packing.pack(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    model = language_id.train(none)
    assert model.langs == [] and language_id.predict(none, model).count() == 0
    assert [r.lang_pred for r in language_id.predict(docs(spark, ["abc"]), model).collect()] == ["und"]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(none, quality.train(none, labels)).count() == 0
    assert licences.scan(none, licences.train(none)).count() == 0


# Jaccard join.


def sets_of(texts, n):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    return out


def union_find(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_texts(seed, n):
    """Groups of copies with few changed words, among unrelated texts with passages in common."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 4000)}"
    passage = [word() for _ in range(60)]
    texts = []
    while len(texts) < n:
        base = [word() for _ in range(rng.choice([1, 2, 5, 9, 20, 60, 150, 400]))]
        if rng.random() < 0.4:
            base[:0] = passage
        for _ in range(rng.choice([1, 1, 3, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 12])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return texts[:n]


@pytest.mark.parametrize("n, num, seed", [(3, 90, 1), (5, 80, 2), (3, 50, 3)])
def test_jaccard_join_by_force(spark, monkeypatch, n, num, seed):
    monkeypatch.setattr(jaccard_join, "COMMON", 5)
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "COPY_MEMBERS", 4)
    texts = near_texts(seed, 260) + ODD
    rows = jaccard_join.join(clashing(docs(spark, texts).repartition(5)), n=n, num=num, den=100).collect()
    s = sets_of(texts, n)
    links = [(a, b) for a in range(len(s)) for b in range(a) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= num * len(s[a] | s[b])]
    want = union_find(len(s), links)
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) and [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(x) for x in s]
    assert all(r.kept == (r.component_id == r.doc_id) for r in rows)


def one_large_group(n, words, edits, seed=1):
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    out = []
    for i in range(n):
        copy = list(base)
        for k in range(edits):
            copy[rng.randrange(words)] = f"x{i}_{k}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("edits", [2, 4])
def test_large_group_sends_few_links(spark, edits):
    """Beyond some blocks: links by members, not by pairs, and the components of brute force."""
    texts = one_large_group(5000, 60, edits)
    df = docs(spark, texts).repartition(8).select(F.col("doc_id").alias("id"), "text")
    radius = jaccard_join.Radius(80, 100)
    sets = store(df.mapInArrow(jaccard_join._sets(3), jaccard_join._SETS), "test-sets")
    regions = jaccard_join.region_members(df, 3, radius)
    links = jaccard_join.region_links(df, sets, regions, 3, radius)
    pairs = [(r.u, r.v) for r in links.collect()]
    assert len(pairs) <= regions.count()
    own = texts[:1200]
    columns = {sh: i for i, sh in enumerate(sorted({sh for x in sets_of(own, 3) for sh in x}))}
    held = np.zeros((len(own), len(columns)), np.float32)
    for i, x in enumerate(sets_of(own, 3)):
        held[i, [columns[sh] for sh in x]] = 1
    inter, size = held @ held.T, held.sum(axis=1)
    a, b = np.nonzero(np.triu(100 * inter >= 80 * (size[:, None] + size[None, :] - inter), 1))
    root = union_find(len(texts), pairs)
    assert all(root[x] == root[y] for x, y in zip(a.tolist(), b.tolist()))
    shingles = sets_of(texts, 3)
    assert all(100 * len(shingles[u] & shingles[v]) >= 80 * len(shingles[u] | shingles[v]) for u, v in pairs)


def test_unrelated_sets_share_no_entry():
    rng = np.random.default_rng(1)
    radius = jaccard_join.Radius(80, 100)
    for size in (6, 10, 20, 60):
        seen = Counter()
        for _ in range(2000):
            seen.update(jaccard_join.entries(np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64)), radius)[0].tolist())
        assert max(seen.values()) <= 20  # of 2,000; where a set has too few parts, empty ones


def test_jaccard_join_odd_ids(spark):
    df = docs(spark, ["a b c d", "a b c d"]).unionByName(docs(spark, ["a b c d", "x y z"]).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs(spark, ["a b c d"], 1))
    rows = jaccard_join.join(df).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows if r.doc_id is not None) == [(0, 0), (1, 0), (1, 0)]
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert jaccard_join.keep_one(df).count() == 3


def test_parts_meet_for_every_close_pair():
    rng = np.random.default_rng(3)
    for num, size in ((90, 40), (80, 25), (80, 300), (90, 700)):
        radius = jaccard_join.Radius(num, 100)
        for _ in range(40):
            a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            b = a.copy()
            differ = 0
            while True:
                trial = b.copy()
                trial[differ] = rng.integers(0, 1 << 63, dtype=np.uint64)
                inter = len(np.intersect1d(a, trial))
                if 100 * inter < num * (2 * size - inter):
                    break
                b, differ = trial, differ + 1
            one, two = jaccard_join.entries(np.unique(a), radius)[0], jaccard_join.entries(np.unique(b), radius)[0]
            assert len(np.intersect1d(one, two)) > 0
            x, y = jaccard_join.sketch(np.unique(a)), jaccard_join.sketch(np.unique(b))
            n = np.array([size])
            assert jaccard_join.may_link([x], [y], n, n, radius)[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_local_stars(edges):
    u, v = (np.array(c) for c in zip(*edges, strict=True))
    want = union_find(31, edges)
    node, low = local_stars(u, v)
    assert dict(zip(node.tolist(), low.tolist(), strict=True)) == {n: want[n] for e in edges for n in e if want[n] != n}


def test_components_by_rounds(spark, monkeypatch):
    import gridloom.llm.components as module

    monkeypatch.setattr(module, "BLOCK_EDGES", 5)
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(50)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long").repartition(6)).collect()}
    want = union_find(161, edges)
    assert all(got.get(n, n) == want[n] for n in range(161))


# Substring dedup.


def removed_by_force(rows, window):
    """rows: (id, text) -> id -> (words, removed, kept text)."""
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone, own = [False] * len(w), []
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if seen.get(key, i) < i:
                gone[s : s + window] = [True] * window
            own.append(key)
        for key in own:
            seen.setdefault(key, i)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_by_force(spark, monkeypatch, seed):
    monkeypatch.setattr(substring_dedup, "GATHER", 200)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 60)
    monkeypatch.setattr(substring_dedup, "READER_WORDS", 50)
    rng = random.Random(seed)
    passages = [[f"p{rng.randint(0, 30)}" for _ in range(rng.randint(8, 40))] for _ in range(6)]
    texts = []
    for _ in range(70):
        w = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, 6)
            w += [f"u{rng.randint(0, 9)}" for _ in range(rng.randint(0, 12))] + p[a : a + rng.randint(4, 40)]
        texts.append(" ".join(w))
    texts += [LONG, LONG, None, "", "x " * 30, "x " * 31]
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(clashing(docs(spark, texts).repartition(4)), window=10, gram=4).collect()}
    want = removed_by_force(list(enumerate(texts)), 10)
    for i, (n, gone, kept) in want.items():
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept).hexdigest())
        assert r.kept_text == (kept.decode() if gone else None)


def test_substring_dedup_odd_ids(spark):
    text = " ".join(f"a{i}" for i in range(60))
    df = docs(spark, [text, text, "z " + text], 1).unionByName(docs(spark, [text], 2)).unionByName(docs(spark, [text, "other " + text], 9))
    df = df.unionByName(docs(spark, ["changed " + text], 9)).unionByName(docs(spark, [text]).withColumn("doc_id", F.lit(None).cast("long")))
    rows = sorted(((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in substring_dedup.remove_repeats(df).collect()))
    assert rows == [
        (False, 1, 0),
        (False, 2, 60),
        (False, 2, 60),
        (False, 3, 60),
        (False, 9, 0),
        (False, 9, 0),
        (False, 10, 60),
        (True, 0, 0),
    ]


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.lists(st.integers(0, 2), max_size=12), min_size=1, max_size=5),
    st.lists(st.integers(0, 2), max_size=12),
    st.integers(0, 6),
    st.integers(1, 4),
)
def test_automaton(references, words, doc, window):
    a = substring_dedup.Automaton()
    for i, r in enumerate(references):
        a.add(r, i)
    a.finish()
    seen = {tuple(r[s : s + window]) for i, r in enumerate(references) if i < doc for s in range(len(r) - window + 1)}
    want, got = [False] * len(words), [False] * len(words)
    for s in range(len(words) - window + 1):
        if tuple(words[s : s + window]) in seen:
            want[s : s + window] = [True] * window
    for x, y in a.spans(words, doc, window):
        got[x:y] = [True] * (y - x)
    assert got == want


# Mixing.


def test_mixing_counts(spark):
    df = clashing(docs(spark, ["abcdefgh"] * 3000)).withColumn(
        "source",
        F.when(F.col("doc_id") < 2500, "big").when(F.col("doc_id") < 2990, "small").otherwise(F.lit(None)),
    )
    out = mixing.mix(df, weights={"big": 1.0, "small": 1.0, "absent": 5.0})
    assert out.columns == [*df.columns, "copy", "order_key"]
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert None not in n and n["big"] == pytest.approx(1500, rel=0.1) and n["small"] == pytest.approx(1500, rel=0.12)
    keys = [r.order_key for r in out.select("order_key").collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    again = mixing.mix(df.repartition(3), weights={"big": 1.0, "small": 1.0, "absent": 5.0})
    assert sorted(r.order_key for r in again.select("order_key").collect()) == keys


def test_poisson_steps(spark):
    for rate in (0.0, 0.3, 5.0, 480.0):
        steps = spark.range(1).select(mixing.distribution(F.lit(rate)).alias("s")).first().s
        assert steps[-1] == pytest.approx(1.0, abs=1e-9) and steps == sorted(steps)
        mean = sum(1 - s for s in steps)
        assert mean == pytest.approx(rate, abs=1e-6)


@pytest.mark.parametrize("n_big", [5_000, 30_000])
def test_mixing_large_rates(spark, n_big):
    df = spark.range(n_big + 3).select(
        F.col("id").alias("doc_id"),
        F.lit("abcdefgh").alias("text"),
        F.when(F.col("id") < 3, "tiny").otherwise("big").alias("source"),
    )
    rate = (n_big + 3) / 6
    got = mixing.rates(df, weights={"big": 1.0, "tiny": 1.0}).where("source = 'tiny'").first().rate
    assert got == pytest.approx(rate) and rate > 500
    rows = mixing.mix(df, weights={"big": 1.0, "tiny": 1.0}).where("source = 'tiny'").groupBy("doc_id").agg(
        F.collect_list("copy").alias("copies"),
        F.countDistinct("order_key").alias("keys"),
    ).collect()
    assert len(rows) == 3 and len({len(r.copies) for r in rows}) > 1
    for r in rows:
        assert abs(len(r.copies) - rate) < 5 * rate**0.5
        assert sorted(r.copies) == list(range(len(r.copies))) and r["keys"] == len(r.copies)


def test_mixing_odd_rows(spark):
    df = docs(spark, [None, "", "a", LONG]).unionByName(docs(spark, ["b"]).withColumn("doc_id", F.lit(None).cast("long")))
    df = df.withColumn("source", F.when(F.col("text").isNull(), F.lit(None)).otherwise(F.coalesce(F.col("text").substr(1, 1), F.lit("e"))))
    assert mixing.mix(df).count() >= 0


# Packing.


def reference_packing(texts, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    out = {}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            out[i, piece] = (at, ids[at : at + capacity])
    return out


@pytest.mark.parametrize("capacity", [16, 4096])
def test_packing(spark, capacity):
    import zlib

    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice([
        "the",
        "Cat's",
        "naïve",
        "3.14",
        "x_y",
        "日本",
        "don't!",
        "İx.",
    ]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    df = docs(spark, texts).repartition(4)
    packed = packing.pack(clashing(df), capacity=capacity)
    rows = packed.collect()
    want = reference_packing(texts, capacity)
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == {k: (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, (at, ids) in want.items()}
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= capacity
        assert sum(3 * length > capacity for _, length in b) <= 2
    assert len(bins) <= 1.25 * -(-sum(r.length for r in rows) // capacity) + 1
    whole = {r.sequence_id: r for r in packing.sequences(df, packed, capacity=capacity).collect()}
    for r in rows:
        assert whole[r.sequence_id].ids[r.offset : r.offset + r.length] == want[r.doc_id, r.piece][1]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 25), max_size=12))
def test_plan_places_each_piece_once(counts):
    bins = defaultdict(list)
    for size, first, sequence, each, offset in packing.plan(counts, 30):
        later = min([f for s, f, *_ in packing.plan(counts, 30) if s == size and f > first], default=counts[size])
        for n in range(later - first):
            bins[sequence + n // each].append((offset + n % each * size, size))
    assert sum(map(len, bins.values())) == sum(counts.values())
    for b in bins.values():
        end = 0
        for offset, size in sorted(b):
            assert offset == end
            end = offset + size
        assert end <= 30


@settings(max_examples=200, deadline=None)
@given(st.lists(
    st.text(st.sampled_from("abcXYZé'ÀÑ \n\t.,;:!?\"<|>1２ ́İςß…🙂-_*#$%&\x1c\x00中ŉǰ\u0338\u00a0\u3000ａＡ가ㄱ"), max_size=40),
    max_size=4,
))
def test_words_give_the_tokenizers_ids(texts):
    got, at = packing._encoder(packing.TOKENIZER).ids(pa.array([*texts, None, ""], pa.string()))
    assert [got[a:b].tolist() for a, b in zip(at, at[1:])] == [_reference().encode(x, add_special_tokens=False).ids for x in [*texts, "", ""]]


def test_long_texts_are_tokenised_in_parts(monkeypatch):
    monkeypatch.setattr(packing, "LEARN_BYTES", 50)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "naïve", "3.14", "日本", "don't!", "x" * 60]) for _ in range(n)) for n in (0, 2, 300, 1, 9, 400, 3)] + [None, "y" * 400]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["id", "text"])
    got = {k: ids.tolist() for k, ids in packing.tokenised(iter([batch.slice(0, 4), batch.slice(4, 0), batch.slice(4)]), packing.TOKENIZER)}
    assert got == {i: _reference().encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}


@pytest.mark.parametrize("seed", range(8))
def test_plan_needs_no_more_sequences_than_best_fit_decreasing(seed):
    rng = random.Random(seed)
    sizes = sorted((min(4096, int(rng.lognormvariate(5.5, 1.5)) + 1) for _ in range(4000)), reverse=True)
    rooms = []
    for size in sizes:
        at = bisect.bisect_left(rooms, size)
        room = rooms.pop(at) if at < len(rooms) else 4096
        bisect.insort(rooms, room - size)
    runs = packing.plan(Counter(sizes), 4096)
    used = set()
    for size, first, sequence, each, _ in runs:
        later = min([f for s, f, *_ in runs if s == size and f > first], default=sizes.count(size))
        used |= {sequence + n // each for n in range(later - first)}
    assert len(used) <= len(rooms)


def _reference(cache=[]):  # noqa: B006
    if not cache:
        from tokenizers import Tokenizer

        cache.append(Tokenizer.from_file(packing.tokenizer_path()))
    return cache[0]


# Models.


def test_forward_sums_all_segmentations():
    pieces = {"▁a": 0, "b": 1, "▁ab": 2, "bc": 3, "c": 4}
    probs = np.zeros((7, 1))
    probs[:6, 0] = [0.3, 0.2, 0.1, 0.15, 0.25, 0.01]
    model = language_id.Model(["x"], pieces, probs)
    # ▁a is not one piece of two letters only: ▁ alone is an unknown letter, as is a.
    want = 0.3 * 0.2 * 0.25 + 0.3 * 0.15 + 0.1 * 0.25 + 0.01**2 * (0.2 * 0.25 + 0.15)
    assert np.exp(language_id.log_probs(["▁abc"], model)[0, 0]) == pytest.approx(want)


def test_language_id_held_out(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    df = spark.read.parquet(path)
    model = language_id.train(df)
    extra = docs(spark, [None, "", "123 ...", "the and of"], 10**6)
    rows = language_id.predict(df.unionByName(extra.select(df.columns)), model).join(
        df.select("doc_id", "lang", (language_id.bucket() == 0).alias("held")),
        "doc_id",
        "left",
    ).collect()
    held = [r for r in rows if r.held]
    assert len(held) > 100 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    odd = {r.doc_id: r.lang_pred for r in rows if r.doc_id >= 10**6}
    assert [odd[10**6 + i] for i in range(4)] == ["und", "und", "und", "en"]
    kept = language_id.keep_identified(df.unionByName(extra.select(df.columns)), model)
    assert kept.columns == df.columns and kept.count() >= df.count() - 2


def test_language_sample_holds_every_language(spark):
    common = docs(spark, [f"the house of number w{i}" for i in range(4000)])
    rare = [docs(spark, [f"{word} {word}{word}"] * 5, 10_000 + 5 * n).withColumn("lang", F.lit(lang)) for n, (lang, word) in enumerate([
        ("xa", "zugzwang"),
        ("xb", "pomlad"),
        ("xc", "kivi"),
        ("xd", "haruspex"),
    ])]
    one_id = docs(spark, ["bonjour monsieur"] * 400).withColumn("doc_id", F.lit(77).cast("long")).withColumn("lang", F.lit("xe"))
    df = common.unionByName(one_id)
    for part in rare:
        df = df.unionByName(part)
    model = language_id.train(df, train_rows=100)
    assert model.langs == ["en", "xa", "xb", "xc", "xd", "xe"]
    got = language_id.predict(docs(spark, ["pomlad", "kivi", "the house of"]), model).collect()
    assert [r.lang_pred for r in sorted(got)] == ["xb", "xc", "en"]
    assert language_id.quotas({"a": 3, "b": 1000, "c": 10**6}, 2000) == {"a": 3.0, "b": 998.5, "c": 998.5}


def test_quality_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 0)
    model = quality.train(df, train)
    assert model.thresholds[0] < model.thresholds[1]
    odd = docs(spark, [None, "", LONG], 10**6).select(df.columns)
    scored = quality.score(clashing(df.unionByName(odd)).drop("kept"), model)
    assert scored.count() == df.count() + 3
    rows = scored.join(labels.join(train, "doc_id", "left_anti"), "doc_id").collect()
    good = [r.quality == 1 and r.toxic == 0 for r in rows]
    assert len(rows) > 60 and np.mean([g == r.kept for g, r in zip(good, rows, strict=True)]) > 0.85
    assert all(abs(r.expected_grade - r.p_not_toxic - r.p_good) < 1e-9 and r.p_good <= r.p_not_toxic for r in rows)


def test_licences(spark):
    plain = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    df = docs(
        spark,
        [
            "x\nLicensed under the Apache License, Version 2.0.\ny",
            "Released under the MIT License.",
            "The license of the poet is wide and the version of it two.",
            None,
            "",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction\n\nAll rights reserved.",
        ],
    )
    model = licences.train(docs(spark, plain["text"]))
    rows = {r.doc_id: r for r in licences.scan(clashing(df), model).collect()}
    assert [rows[i].licences for i in range(6)] == ["Apache-2.0", "MIT", "", "", "", "MIT,Proprietary"]
    assert rows[0].found[0].paragraph == 1 and rows[0].n_paragraphs == 3 and rows[3].n_paragraphs == 1
    held = [words for t in plain["text"] for words in licences.paragraphs(t)]
    assert licences.fit(held[:500]).families == list(licences.TEMPLATES)


WRAPPED = {
    "MIT": (
        78,
        "MIT License\n\nCopyright (c) 2020 A. Name\n\n",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    ),
    "BSD": (
        72,
        "",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "GPL": (
        70,
        "",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL": (
        70,
        "",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "CC-BY-SA": (46, "", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
}


def test_licences_over_lines(spark):
    plain = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()["text"]]
    want = []
    for family, (width, head, notice) in WRAPPED.items():
        for mark in ("", "# ", " * ", "// "):
            wrapped = "\n".join(mark + row for row in (head + textwrap.fill(notice, width)).split("\n"))
            want += [(t, family) for t in (
                wrapped,
                f"def f():\n{wrapped}\nreturn 1",
                wrapped.replace("\n", "\r\n"),
                wrapped.replace("\n", "\n\n"),
            )]
    prose = max((t for t in plain if "licen" not in t.lower() and "rights" not in t.lower()), key=len).replace("\n", " ")
    want += [(prose, ""), ("Licensed under the Mozilla Public\nLicense, version 2.0", "MPL-2.0")]
    # Two in one line, two in a document of one line, two wrapped into each other.
    want.append(("Licensed under the Apache License, Version 2.0 or the MIT License.", "Apache-2.0,MIT"))
    want.append((f"{prose} {WRAPPED['MIT'][2]} {prose} {WRAPPED['GPL'][2]} {prose}", "GPL,MIT"))
    want.append((textwrap.fill(f"{WRAPPED['BSD'][2]} {WRAPPED['LGPL'][2]}", 60), "BSD,LGPL"))
    rows = licences.scan(docs(spark, [t for t, _ in want]), licences.train(docs(spark, plain))).collect()
    got = {r.doc_id: r.licences for r in rows}
    assert [(t, got[i]) for i, (t, _) in enumerate(want)] == want


def plain_log_probs(word, model):
    """The forward algorithm, one number at a time, in exact integers' logarithms."""
    from fractions import Fraction

    out = []
    for lang in range(len(model.langs)):
        alpha = [Fraction(1)] + [Fraction(0)] * len(word)
        for start in range(len(word)):
            for stop in range(start + 1, len(word) + 1):
                piece = model.pieces.get(word[start:stop], -2 if stop == start + 1 else None)
                if piece is not None:
                    alpha[stop] += alpha[start] * Fraction(float(model.probs[piece, lang]))
        top = alpha[-1]
        out.append(np.log(float(top.numerator >> max(0, top.numerator.bit_length() - 60))) + max(0, top.numerator.bit_length() - 60) * np.log(2) - (np.log(float(top.denominator >> max(0, top.denominator.bit_length() - 60))) + max(0, top.denominator.bit_length() - 60) * np.log(2)))
    return out


def test_words_of_any_length_sum_all_segmentations(monkeypatch):
    monkeypatch.setattr(language_id, "LONG_STEP", 50)
    rng = random.Random(8)
    pieces = {p: i for i, p in enumerate(dict.fromkeys([
        "▁a",
        "a",
        "b",
        "ab",
        "▁ab",
        "ba",
        "aba",
        "▁abab",
        "ababababab",
        "中",
        "▁中",
        "bé",
        "é",
    ]))}
    probs = np.array([[rng.random() * 1e-5, rng.random()] for _ in range(len(pieces) + 2)])
    probs[-1] = 0
    model = language_id.Model(["x", "y"], pieces, probs)
    words = ["▁" + "".join(rng.choice("aabbé中z") for _ in range(n)) for n in (1, 2, 5, 30, 63, 64, 120, 160)] + ["▁" + "ab" * 70]
    got = language_id.log_probs(words, model)
    for word, row in zip(words, got):
        assert row == pytest.approx(plain_log_probs(word, model), rel=1e-9)


def test_language_of_odd_texts(spark):
    model = language_id.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    texts = ["½ ² 12", "Ⅷ ①", "٣ __ -", "1½the", "the" * 5000, "x" * 100_000, "ª", None, "İ and the"]
    rows = {r.doc_id: r for r in language_id.predict(clashing(docs(spark, texts)), model).collect()}
    assert [rows[i].lang_pred == "und" for i in range(len(texts))] == [True, True, True, False, False, False, False, True, False]
    assert all((r.score == 0) == (r.lang_pred == "und") and 0 <= r.score <= 1 for r in rows.values())
    assert language_id.letter_runs("a½bⅧc1d_e中f") == ["a", "b", "c", "d", "e中f"]


def test_language_query_by_force(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    df = spark.read.parquet(path)
    model = language_id.train(df)
    rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: len(r.text or ""))[:40]
    got = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    seen = {}
    for row in rows:
        words = [w for t in (row.text or "").split() for w in language_id.marked_words(t)]
        sums = np.zeros(len(model.langs))
        for w in words:
            if w not in seen:
                seen[w] = np.array(plain_log_probs(w, model))
            sums += seen[w]
        if not words:
            assert (got[row.doc_id].lang_pred, got[row.doc_id].score) == ("und", 0.0)
            continue
        assert got[row.doc_id].lang_pred == model.langs[int(sums.argmax())]
        assert got[row.doc_id].score == pytest.approx(1 / np.exp(sums - sums.max()).sum(), rel=1e-6)


def slopes(value, x, at, eps=1e-5):
    """Differences of ``value`` for small changes of some numbers of ``x``."""
    out = []
    for i in at:
        up, down = x.copy(), x.copy()
        up.flat[i] += eps
        down.flat[i] -= eps
        out.append((value(up) - value(down)) / (2 * eps))
    return out


def test_quality_gradient_and_likelihood():
    rng = np.random.default_rng(4)
    grades = rng.integers(0, 3, 40)
    features = [np.unique(rng.integers(0, 12, 6)) for _ in grades]
    flat, owner = np.concatenate(features), np.repeat(np.arange(40), [len(f) for f in features])
    w, step = rng.normal(size=12), np.array([-0.7, 0.3])
    value, dw, dstep = quality.loss(w, step, flat, owner, grades, 0.5)
    theta = [-0.7, -0.7 + math.exp(0.3)]
    plain = 0.0
    for f, grade in zip(features, grades):
        below = [0.0, *(1 / (1 + math.exp(-(t - w[f].sum()))) for t in theta), 1.0]
        plain -= math.log(below[grade + 1] - below[grade])
    assert value == pytest.approx(plain + 0.25 * (w @ w))
    assert dw == pytest.approx(slopes(lambda x: quality.loss(x, step, flat, owner, grades, 0.5)[0], w, range(12)), rel=1e-4, abs=1e-6)
    assert dstep == pytest.approx(slopes(lambda x: quality.loss(w, x, flat, owner, grades, 0.5)[0], step, range(2)), rel=1e-4, abs=1e-6)


def test_quality_query_by_force(spark):
    sf = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(df, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: r for r in quality.score(df, model).collect()}
    for row in df.where("doc_id % 20 = 0").select("doc_id", "text").collect():
        tokens = (row.text or "").encode().split()
        traits = [quality.token_traits(t) for t in tokens]
        words = {w for w, _ in traits if w >= 0}
        n = max(1, len(tokens))
        shares = [sum(b >> k & 1 for _, b in traits) / n for k in range(4)] + [1 - len(words) / n]
        steps = [quality.SPACE + k * quality.STEPS + min(
            quality.STEPS - 1,
            math.ceil(x * 20) if x < 0.2 else 4 + int(x * 4),
        ) for k, x in enumerate(shares)]
        score = sum(float(model.weights[f]) for f in [*words, *steps])
        tails = [1 / (1 + math.exp(-(score - t))) for t in model.thresholds]
        r = got[row.doc_id]
        assert (r.expected_grade, r.p_not_toxic, r.p_good) == pytest.approx((sum(tails), *tails), abs=1e-4)
        assert r.kept == (r.p_good >= 0.5)


def wrapped(text, width, mark):
    import textwrap

    return "\n".join(mark + line for line in textwrap.wrap(text, width, break_on_hyphens=False))


def test_licences_and_their_neighbours(spark, sf):
    """Each template, plain, wrapped or behind comment marks, is confirmed as its own family and no other; licences like them are not."""
    plain = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(150).collect()]
    model = licences.train(docs(spark, plain))
    texts, want = [], []
    for family, notices in licences.TEMPLATES.items():
        for notice in notices:
            for form in (notice, wrapped(notice, 60, "# "), "some words\n\n" + wrapped(notice, 44, " * ") + "\n\nmore words"):
                texts.append(form)
                want.append(family)
    got = {r.doc_id: r.licences for r in licences.scan(docs(spark, texts), model).collect()}
    wrong = [(texts[i], w, got[i]) for i, w in enumerate(want) if got[i] != w]
    assert not wrong, wrong[:5]
    others = [
        *licences.NEIGHBOURS,
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Xyzzy General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Frobnitz General Public License, version 3.",
        "the license of the poem is broad and its terms are kind",
    ]
    got = {r.doc_id: r.licences for r in licences.scan(docs(spark, others), model).collect()}
    assert [(others[i], x) for i, x in got.items() if x] == []


def test_licence_gradient():
    rng = np.random.default_rng(6)
    x, y, weight = (rng.random((30, 9)) < 0.4).astype(float), rng.integers(0, 4, 30), rng.random(30)
    w = rng.normal(size=(10, 4))
    _, g = licences.loss(w, x, y, weight)
    assert g.ravel() == pytest.approx(slopes(lambda v: licences.loss(v, x, y, weight)[0], w, range(40)), rel=1e-4, abs=1e-6)


def test_licence_lines_by_force(spark):
    """Every line that the classifier takes for a licence, by plain sums over its word sequences."""
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pydict()["text"]]
    model = licences.train(docs(spark, texts))
    place = {int(f): i for i, f in enumerate(model.features)}
    rows = licences.scan(docs(spark, texts), model).collect()
    hits = 0
    for r in rows:
        found = {f.paragraph: f for f in r.found}
        for i, line in enumerate(licences.paragraphs(texts[r.doc_id])):
            seen = {place[int(g)] for part in licences.grams(jaccard_join.W.hashed(line)) for g in part if int(g) in place}
            if not seen:
                continue
            sums = [sum(model.weights[f, k] for f in seen) + model.weights[-1, k] for k in range(len(model.families) + 1)]
            top = max(range(len(model.families)), key=sums.__getitem__)
            p = 1 / (1 + math.exp(-(model.slope * (sums[top] - sums[-1]) + model.offset)))
            if p >= licences.MIN_PROBABILITY and abs(p - 0.5) > 1e-9:
                hits += 1
                assert i in found and (found[i].family == model.families[top] or found[i].confirmed)
                if found[i].family == model.families[top]:
                    assert found[i].probability == pytest.approx(p, abs=1e-6)
    assert hits > 10


def test_licences_of_odd_rows(spark):
    notice = "Released under the MIT License."
    df = docs(spark, [notice, notice, f"{'word ' * 200_000}\n{notice}"]).unionByName(docs(spark, [notice]).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs(spark, [notice]))
    model = licences.train(docs(spark, ["a plain line of words"] * 30))
    rows = licences.scan(clashing(df), model).collect()
    assert len(rows) == 5 and all(r.licences == "MIT" for r in rows)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("broadcast", [0, 100])
def test_facts_meet_members_of_large_groups(spark, monkeypatch, how, broadcast):
    monkeypatch.setattr(frames, "HOT_ROWS", 10)
    members = spark.range(300).select(F.when(F.col("id") < 200, 1).otherwise(F.col("id") % 7).alias("key"), "id")
    facts = members.where("key <> 3").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    want = sorted(map(tuple, members.join(facts, "key", how).collect()))
    got = frames.attach(members, facts, ["key"], [F.col("id")], how, "n", broadcast)
    assert sorted(map(tuple, got.collect())) == want and got.count() == len(want)
