"""WARC archives, vectors, the registered queries and the pipeline."""

import math
import os
import random
import zlib
from urllib.parse import unquote

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import embedding_dedup, jaccard_join, packing, queries, warc

FIELDS = "page_id long, url string, html string, other int"


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://x/{i} y", h, 1) for i, h in rows], FIELDS)


HTML = [
    (0, "<p>a</p>"),
    (1, None),
    (2, ""),
    (3, "<p>a</p>"),
    (4, "é" * 1000),
    (5, "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
    (6, "x" * 3_000_000),
    (None, "<p>a</p>"),
    (None, "alone"),
    (3, "<p>a</p>"),
]


@pytest.mark.parametrize("compressed", [True, False])
def test_archives_round_trip(spark, tmp_path, compressed):
    df = pages(spark, HTML)
    path = f"file://{tmp_path}/w"
    warc.write_archives(df.repartition(3), path, compressed=compressed)
    found = warc.read_archives(spark, path)
    assert warc.gaps(found).count() == 0
    rows = warc.records(found).collect()
    assert len(rows) == len(HTML)
    for r in rows:
        key = None if r.record_id == "null" else int(r.record_id)
        html = next(h for i, h in HTML if i == key and (key is not None or warc.digest((h or "").encode()) == r.payload_digest))
        data = (html or "").encode()
        same = [i for i, h in HTML if (h or "") == (html or "")]
        top = max((i for i in same if i is not None), default=None)
        assert (r.payload_bytes, r.payload_digest) == (len(data), warc.digest(data))
        assert (r.kind, r.refers_to) == (("response", None) if key == top or len(same) == 1 else ("revisit", str(top)))
        assert r.payload == (data if r.kind == "response" else b"")


ODD_URLS = [
    "http://x/" + "a" * 70_000,
    "http://x/" + "é" * 400_000,
    "http://x/\x00\x08\x0e\x1b",
    "http://x/WARC/1.0",
    "WARC/1.1",
    "a\r\nWARC/1.1\r\n\r\nb",
    "\x7f\x85\xa0\u2028",
    "",
    None,
]


@pytest.mark.parametrize("compressed", [True, False])
def test_archives_with_odd_urls(spark, tmp_path, compressed):
    df = spark.createDataFrame([(i, u, f"<p>{i}</p>") for i, u in enumerate(ODD_URLS)], "page_id long, url string, html string")
    warc.write_archives(df.repartition(1), f"file://{tmp_path}/w", compressed=compressed)
    found = warc.read_archives(spark, f"file://{tmp_path}/w")
    assert warc.gaps(found).count() == 0
    got = {int(r.record_id): r for r in warc.records(found).collect()}
    assert [unquote(got[i].target_uri or "") for i in range(len(ODD_URLS))] == [u or "" for u in ODD_URLS]
    assert all(r.payload == f"<p>{i}</p>".encode() for i, r in got.items())
    assert sorted(r.page_id for r in warc.round_trip(df).collect()) == list(range(len(ODD_URLS)))


def test_round_trip_counts_its_rows(spark, monkeypatch):
    df = pages(spark, HTML)
    monkeypatch.setattr(warc, "records", lambda found: found.where("kind <> 'gap' and record_id <> '4'"))
    with pytest.raises(RuntimeError, match="10 pages written, 9 records read"):
        warc.round_trip(df)


def test_headers_run_together():
    a, b = (warc.record("resource", b"abc", {"WARC-Record-ID": f"<{warc.PREFIX}{i}>"}) for i in range(2))
    for at in range(20, a.index(warc._END)):
        kinds = [(x.kind, x.headers.get("warc-record-id")) for x in warc.salvage(a[:at] + b)]
        assert kinds == [("gap", None), ("resource", f"<{warc.PREFIX}1>")], at


def archive(n, compressed):
    rng = random.Random(n)
    records = [warc.record(
        "resource",
        bytes(rng.randrange(256) for _ in range(rng.randint(0, 400))),
        {"WARC-Record-ID": f"<{warc.PREFIX}{i}>"},
    ) for i in range(n)]
    parts = [warc.member(r) for r in records] if compressed else records
    starts = np.cumsum([0, *map(len, parts)]).tolist()
    return b"".join(parts), starts


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("damage", ["flip", "cut", "insert", "header", "zero"])
def test_salvage(compressed, damage):
    data, starts = archive(12, compressed)
    hit = bytearray(data)
    at = starts[5] + 30
    if damage == "flip":
        hit[starts[6] - 20 if not compressed else at] ^= 0xFF
    elif damage == "cut":
        del hit[at : at + 60]
    elif damage == "insert":
        hit[starts[5] : starts[5]] = b"junk" * 9
    elif damage == "header":
        hit[starts[5] : starts[5] + 4] = b"ABCD"
    else:
        hit[at : starts[6]] = bytes(starts[6] - at)
    found = list(warc.salvage(bytes(hit)))
    ids = [int(x.headers["warc-record-id"].strip("<>").removeprefix(warc.PREFIX)) for x in found if x.kind != "gap"]
    gaps = [x for x in found if x.kind == "gap"]
    assert set(range(12)) - {5} <= set(ids) and gaps and all(g.reason and g.start < g.end for g in gaps)
    spans = sorted((x.start, x.end) for x in found)
    assert spans[0][0] == 0 and spans[-1][1] == len(hit) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_salvage_of_nothing_and_junk():
    assert list(warc.salvage(b"")) == []
    assert [x.kind for x in warc.salvage(b"junk" * 100)] == ["gap"]
    assert zlib.decompress(warc._NOTHING, 31) == b""


def force(rows, threshold):
    """rows: (id, vector, label) -> id -> (links, component)."""
    ok = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    good = [(i, np.array(v, float) / np.linalg.norm(v), lab) for i, v, lab in rows if lab is not None and ok(v)]
    links, root = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            (i, x, p), (j, y, q) = good[a], good[b]
            if p == q and len(x) == len(y) and x @ y >= threshold:
                links[i] += 1
                links[j] += 1
                r, s = find(i), find(j)
                root[max(r, s)] = min(r, s)
    return {i: (links[i], find(i)) for i in links}


@pytest.mark.parametrize("block", [5, 512])
def test_embedding_dedup_by_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(60):
        base = rng.normal(size=64)
        for _ in range(int(rng.choice([1, 1, 2, 5]))):
            rows.append((base + rng.normal(size=64) * rng.choice([0, 0.02, 0.1])).astype(np.float32).tolist())
    base = rng.normal(size=64)
    rows += [(base + rng.normal(size=64) * 0.03).astype(np.float32).tolist() for _ in range(60)]
    table = [(i, v, int(i % 3 > 1)) for i, v in enumerate(rows)]
    n = len(table)
    table += [
        (n, None, 1),
        (n + 1, [0.0] * 64, 1),
        (n + 2, [math.nan] * 64, 1),
        (n + 3, [None] * 64, 1),
        (n + 4, rows[0], None),
        (n + 5, [1.0, 2.0, 3.0], 0),
        (n + 6, [1.0, 2.0, 3.0], 0),
        (n + 7, [], 0),
        (n + 8, [math.inf] + [0.0] * 63, 0),
    ]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1)).withColumn("key", F.lit(2)).repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    want = force(table, 0.98)
    total = sum(x for x, _ in want.values())
    assert len(got) == len(table) and total > 1000
    assert all(got[i].n_links <= want[i][0] for i in want)
    assert sum(r.n_links for r in got.values()) >= 0.9 * total
    assert np.mean([got[i].component_id == want[i][1] for i in want]) >= 0.95
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(embedding_dedup.hadamard(x), axis=1), np.linalg.norm(x, axis=1))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    c = duckdb.connect()
    for file in os.listdir(sf):
        path = f"{sf}/{file}"
        c.sql(f"create view {file.split('.')[0]} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    df = queries.queries()[name](spark, sf)
    columns = sorted(df.columns)
    want = c.sql(queries.oracle_sql()[name])
    order = [want.columns.index(x) for x in columns]
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(
        repr,
        (tuple(r[i] for i in order) for r in want.fetchall()),
    ))


@pytest.mark.parametrize("name", sorted(queries.queries().keys() - queries.oracle_sql().keys()))
def test_query_covers_its_table(spark, sf, name):
    table = "embeddings" if name.startswith("op6") else "documents"
    key = "vec_id" if table == "embeddings" else "doc_id"
    df = queries.queries()[name](spark, sf)
    assert {r[0] for r in df.select(key).collect()} == {r[0] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(key).collect()}


def test_pipeline(spark, sf, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "mixing", "packing"]
    start = spark.read.parquet(f"{sf}/documents.parquet")
    docs, before = start, None
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        if name != "packing":
            assert docs.columns == start.columns
        ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
        assert ids(docs) <= ids(before)
        if name == "language_id":
            assert docs.count() >= 0.97 * start.count()
        elif name == "exact_dedup":
            texts = [r[0] for r in before.select("text").collect()]
            assert sorted(r[0] for r in docs.select("text").collect()) == sorted(set(texts))
        elif name == "jaccard_join":
            rows = sorted((r.doc_id, r.text) for r in before.select("doc_id", "text").collect())
            shingles = [(
                i,
                {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)},
            ) for i, w in ((i, t.encode().lower().split()) for i, t in rows)]
            root = {i: i for i, _ in shingles}

            def find(x, root=root):
                while root[x] != x:
                    x = root[x]
                return x

            for a in range(len(shingles)):
                for b in range(a):
                    x, y = shingles[a][1], shingles[b][1]
                    if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and 10 * len(x & y) >= 8 * len(x | y):
                        r, s = find(shingles[a][0]), find(shingles[b][0])
                        root[max(r, s)] = min(r, s)
            assert ids(docs) == {find(i) for i, _ in shingles}
    total = docs.agg(F.sum("length")).first()[0]
    assert docs.select("sequence_id").distinct().count() <= 1.05 * total / packing.CAPACITY + 1
    ends = docs.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert ends.where("n <> end or n > 4096").count() == 0


def odd_documents(spark, path, rows):
    """A folder with a table of documents that has more columns, some of names that operators use."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("id", "key", "n", "copy", "row", "size", "region"):
        df = df.withColumn(name, F.lit("x"))
    df.write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, odd_documents(spark, tmp_path, [])).count() == 0


def test_pipeline_on_odd_rows(spark, tmp_path):
    words = {"en": "the house and the river of the old town", "de": "das Haus und der Fluss von der alten Stadt"}
    rows = [(i, f"{words[lang]} w{i % 7}", lang, "s", 10) for i in range(40) for lang in words]
    rows += [
        (None, "the house and the garden", "en", None, None),
        (90, None, "en", "s", 0),
        (91, "", None, None, 0),
        (92, "½ 12", "en", "s", 4),
        (93, "the river " * 3000, "en", "t", 9),
        (93, "the river " * 3000, "en", "t", 9),
    ]
    sf = odd_documents(spark, tmp_path, rows)
    before = jaccard_join.join(spark.read.parquet(f"{sf}/documents.parquet"))  # lazy, of this session
    out = corpus_pipeline.run(spark, sf)
    ids = {r.doc_id for r in out.collect()}
    assert {93, None} <= ids and not ids & {90, 91, 92}
    assert before.count() == len(rows)


def test_vectors_of_any_size(spark):
    rows = [
        (1, [1e200, 1e200], 0),
        (2, [2e200, 2e200], 0),
        (3, [1e-200, 1e-200], 0),
        (4, [5e-324, 5e-324], 0),
        (5, [1.7e308, -1.7e308], 0),
        (6, [3.0, 3.0], 0),
        (7, [1e-200, -1e-200], 0),
        (8, [0.0, -0.0], 0),
        (8, [1.0, 1.0], 1),
        (9, [1e300, 1e300], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {(r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {(1, 4, 1), (2, 4, 1), (3, 4, 1), (4, 4, 1), (6, 4, 1), (5, 1, 5), (7, 1, 5), (8, 1, 8), (9, 1, 8)}


def test_vectors_with_repeated_ids(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.001], 0), (2, [0.0, 1.0], 0), (3, [0.001, 1.0], 0)],
        "vec_id long, embedding array<double>, label int",
    )
    got = sorted({(r.vec_id, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()})
    assert [x[0] for x in got] == [1, 2, 3]


def test_round_trip_of_an_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string, id long, uri string, payload string")
    assert warc.round_trip(none).count() == 0
