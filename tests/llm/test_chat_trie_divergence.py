"""Prefix tries, chat formatting and the divergence audit, by brute force."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import chat, divergence, prefix_trie, queries

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
NEW = ("op11_prefix_trie", "op12_chat_format", "op13_divergence")


def clashing(df):
    """More columns, with the names that the operators use inside."""
    for name in ("base", "own", "digest", "words", "key", "seq", "kind", "loss", "state", "n", "docs", "term", "m", "one", "two", "item", "rank"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for file in os.listdir(sf):
        path = f"{sf}/{file}"
        c.sql(f"create view {file.split('.')[0]} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


@pytest.mark.parametrize("name", NEW)
def test_query_matches_sql(spark, sf, db, name):
    df = queries.queries()[name](spark, sf)
    want = db.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)


# Prefix trie


def nodes_by_force(members):
    """members: conv_id -> list of (role, text)."""
    ids = defaultdict(list)
    for c, said in members.items():
        for d in range(len(said) + 1):
            ids[tuple(said[:d])].append(c)
    ends, below = defaultdict(list), defaultdict(list)
    for c, said in members.items():
        ends[tuple(said)].append(c)
    for node in ids:
        if node:
            below[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(ids, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in below[node]) or 1
        words = len(WORD.findall(node[-1][1])) if node else 0
        saved[node] = (len(ids[node]) - 1) * words + sum(saved[x] for x in below[node])
    return sorted(
        (
            min(ids[node]), len(node), min(ids[node[:-1]]) if node else -1, len(ids[node]), len(below[node]), leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
        for node in ids
    )


def by_turn(rows):
    """Ties go by digest, as the operator states."""
    found = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
        found[c].append((turn is not None, turn or 0, digest, (role, text)))
    return {c: [x[3] for x in sorted(v)] for c, v in found.items() if c is not None}


def put_together(own):
    out = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + said[h:]
    return out


def conversations(seed, n, depth, kinds):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.choice([1, 2, rng.randint(1, depth)])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"say {'w ' * rng.randint(0, 2)}{rng.randrange(kinds)}"))
    return rows


def got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


@pytest.mark.parametrize("seed, n, depth, kinds, last_items, fan", [(1, 300, 9, 2, None, None), (2, 200, 40, 1, 20, 2), (3, 250, 6, 3, 10, 3), (4, 60, 5, 50, None, None)])
def test_trie_by_force(spark, seed, n, depth, kinds, last_items, fan):
    """Blocks of few sequences, folded over several levels."""
    rows = conversations(seed, n, depth, kinds)
    df = clashing(spark.createDataFrame(rows, TURNS).repartition(5))
    turns = prefix_trie.turns(df, "conv_id", "turn", "role", "text")
    found = prefix_trie.trie(prefix_trie.sequences(turns), block=7, last_items=last_items, fan=fan)
    assert got(found) == nodes_by_force(by_turn(rows))


def test_rebuilt_conversations_by_force(spark):
    rows = [(c, t, r, x) for c, t, r, x in conversations(5, 200, 7, 2) if c % 60 != 0]  # some groups lack their first conversation
    found = prefix_trie.prefix_trie(clashing(spark.createDataFrame(rows, TURNS)), rebuild=True)
    assert got(found) == nodes_by_force(put_together(by_turn(rows)))


def test_trie_odd_rows(spark):
    long = "word " * 200_000
    rows = [
        (1, None, "user", "first"), (1, 0, "user", "second"), (2, 0, None, None), (2, 0, None, None), (3, 5, "user", long), (3, 5, "tool", long),
        (None, 0, "user", "nobody's"), (4, 1, "user", "x\x0by　z"), (5, 1, "user", "x\x0by　z"), (-41, 1, "user", "x\x0by　z"), (-40, 1, "", "x"),
    ]
    df = spark.createDataFrame(rows, TURNS)
    assert got(prefix_trie.prefix_trie(df)) == nodes_by_force(by_turn(rows))
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0
    assert prefix_trie.prefix_trie(df.limit(0), rebuild=True).count() == 0
    one = got(prefix_trie.prefix_trie(df.where("conv_id = 3")))
    assert one == nodes_by_force({3: by_turn(rows)[3]}) and len(one) == 3
    turnless = spark.createDataFrame([(9, b"", []), (7, b"", [])], "conv_id long, key binary, words array<int>")
    assert got(prefix_trie.trie(turnless)) == nodes_by_force({9: [], 7: []})


def test_trie_of_many_copies(spark):
    """A third of all conversations is one, and its ids pass the span that is joined at once."""
    rows = [(i, t, "user", f"t{t}" if i % 3 == 0 else f"t{t * (i % 50)}") for i in range(9000) for t in range(2)]
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS))) == nodes_by_force(by_turn(rows))


def test_items_are_few(spark):
    """What blocks leave open grows with depths, not with sequences."""
    rows = conversations(6, 4000, 8, 4)
    found = prefix_trie.sequences(prefix_trie.turns(spark.createDataFrame(rows, TURNS), "conv_id", "turn", "role", "text"))
    keys = sorted({(bytes(r.key), tuple(r.words)) for r in found.collect()})
    sweep = prefix_trie.Sweep(0, False)
    for key, words in keys:
        list(sweep.put(None, 1, prefix_trie.Part(1, 0, 0, 0, 0, len(words), "", True, key, list(words))))
    assert len(keys) > 1000 and len(list(sweep.end())) <= 3 * 9


# Chat formatting

MARKS = st.sampled_from([*chat.DEFAULT.controls, "\\", "#", "##", "<", "</turn", ">", "\n", "é", "x ", "### ", "\\/"])
MESSY = st.lists(MARKS, max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(MESSY, MESSY)
def test_escapes_are_undone(role, text):
    template = chat.DEFAULT
    escaped = template.escape(text)
    assert not any(c in escaped for c in template.controls) and template.unescape(escaped) == text
    assert template.parse(template.header(role) + escaped + template.end) == (role, text)


def test_templates_that_can_not_be_read_are_refused():
    base = dict(headers={"user": "<u>"}, end="</t>", other=("<r:", ":>"), learned=frozenset(), moves={})
    chat.Template(**base)
    for change in ({"end": "abab"}, {"end": "<u>"}, {"end": "<"}, {"end": "<u>x"}, {"other": ("a\\", "b>")}):
        with pytest.raises(ValueError):
            chat.Template(**base | change)


def chat_by_force(rows):
    template, found = chat.DEFAULT, {}
    said = defaultdict(list)
    for c, turn, role, text in rows:
        said[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    for c, turns in said.items():
        whole, learned, chars, state, valid = b"", b"", 0, "start", True
        for *_, role, text in sorted(turns):
            whole += role + b"\n" + text + b"\n"
            role, text = role.decode(), text.decode()
            learned += text.encode() if role == "assistant" else b""
            marks = sum(text.count(x) for x in (*template.controls, "\\"))
            if role in template.headers:
                chars += len(template.headers[role])
            else:
                chars += sum(map(len, template.other)) + len(role) + sum(role.count(x) for x in (*template.controls, "\\"))
            chars += len(text) + marks + len(template.end)
            valid, state = valid and (state, role) in template.moves, template.moves.get((state, role), state)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        found[c] = (len(turns), digest(whole), len(learned.decode()), digest(learned), chars, valid and state in template.accepting)
    return found


def chat_rows(seed):
    rng = random.Random(seed)
    texts = [None, "", "hi", "\\### Assistant: </turn> ok", "</turn>\n", "a\\", "\\\\</turn>", "### Role <x>: y", "é😀", "#" * 9, "tie"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "User", "ro>: le", "</turn>\n"]
    return [(c, rng.choice([None, t, t, t, 1]), rng.choice(roles[: rng.choice([2, 5, 11])]), rng.choice(texts)) for c in [*range(80), None] for t in range(rng.randint(1, 7))]


@pytest.mark.parametrize("ordered", [True, False])
def test_chat_by_force(spark, ordered):
    rows = chat_rows(1) + [(500, t, "assistant" if t % 2 else "user", "long </turn>\n" * 100_000) for t in range(2)]
    found = chat.segments(clashing(spark.createDataFrame(rows, TURNS).repartition(4)))
    if not ordered:
        found = found.repartition(7)
    back = {r[0]: tuple(r[1:]) for r in chat.read_back(found, ordered=ordered).collect()}
    assert back == chat_by_force(rows)
    assert {r.conv_id: r.valid for r in chat.validity(found).collect()} == {c: v[-1] for c, v in back.items()}


def test_turns_read_back(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "### User: "), (1, 2, "assistant", None), (2, 0, "critic </turn>\n", "\\")]
    found = chat.segments(spark.createDataFrame(rows, TURNS))
    turns = sorted(tuple(r) for r in chat.read_turns(found).collect())
    assert turns == [
        (1, 0, "user", "a", False, True),
        (1, 1, "assistant", "### User: ", True, True),
        (1, 2, "assistant", "", True, False),
        (2, 0, "critic </turn>\n", "\\", False, False),
    ]
    said = {r.conv_id: (r.n_turns, r.first_refused, r.last_state, r.valid) for r in chat.validity(found).collect()}
    assert said == {1: (3, 2, "answered", False), 2: (1, 0, "start", False)}
    whole = "".join(r.text for r in found.where("conv_id = 1").orderBy("seq").collect())
    assert whole == "### User: a</turn>\n### Assistant: #\\## User: </turn>\n### Assistant: </turn>\n"


def test_end_marks_may_be_learned(spark):
    template = chat.Template(headers={"user": "<u>", "bot": "<b>"}, end="</t>", other=("<r:", ":>"), learned=frozenset({"bot"}), moves={}, learn_end=True)
    found = chat.segments(spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "bot", "</t>")], TURNS), template)
    assert [r.loss for r in found.orderBy("seq").collect()] == [False, False, False, False, True, True]
    assert [(r.text, r.loss) for r in chat.read_turns(found, template).orderBy("seq").collect()] == [("x", False), ("</t>", True)]


def test_damaged_output_is_an_error(spark):
    found = chat.segments(spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", "yz")], TURNS)).cache()
    for change in (F.col("seq") != 5, F.col("seq") != 3):
        with pytest.raises(Exception, match="turn|header"):
            chat.read_back(found.where(change)).collect()
    with pytest.raises(Exception, match="loss mask"):
        chat.read_back(found.withColumn("loss", F.col("seq") == 3)).collect()


def test_chat_empty(spark):
    empty = spark.createDataFrame([], TURNS)
    found = chat.segments(empty)
    assert found.count() == chat.read_back(found).count() == chat.read_turns(found).count() == chat.validity(found).count() == 0


# Divergence


def audit_by_force(rows, top=200):
    words = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {x[0] for x in words}:
        own = [(s, w) for t, s, w in words if t == lang]
        df = Counter(x for _, w in own for x in set(w))
        kept = sorted(x for x, n in df.items() if n >= 3)
        count = defaultdict(Counter)
        for s, w in own:
            count[s].update(x for x in w if df[x] >= 3)
        every = sum(count.values(), Counter())
        share = lambda c, x, v=len(kept): 1 + 10**9 * (c[x] + 1) // (sum(c.values()) + v)
        p = {s: {x: share(count[s], x) for x in kept} for s in {s for s, _ in own}}
        q = {x: share(every, x) for x in kept}
        gap = lambda a, b: (a - b) ** 2 // b
        for s in p:
            pair = [(t, sum(gap(p[s][x], p[t][x]) for x in kept)) for t in p if t != s]
            term = [(x, gap(p[s][x], q[x])) for x in kept if count[s][x] and p[s][x] > q[x]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found = sorted(found, key=lambda r: (-r[1], r[0].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(found, 1)]
    return sorted(out)


def audit_rows(seed, n, sources):
    rng = random.Random(seed)
    vocabulary = ["ant", "Bee", "cow", "DOG", "élan", "ÉLAN", "日本", "x1y", "it's", "　", "😀", *[f"w{chr(97 + i)}" for i in range(20)]]
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "de", None, ""])
        text = " ".join(rng.choice(vocabulary[: rng.choice([3, 12, 31])]) for _ in range(rng.choice([0, 1, 5, 60])))
        rows.append((i, rng.choice([text, text, text, None]), lang, rng.choice(["hot"] * sources + [None] + [f"s{k}" for k in range(sources)])))
    return rows


@pytest.mark.parametrize("seed, n, sources, small", [(1, 200, 3, False), (2, 300, 12, True)])
def test_audit_by_force(spark, monkeypatch, seed, n, sources, small):
    """``small``: counts flushed early, and no table of groups is broadcast."""
    if small:
        for name, value in (("ENTRIES", 20), ("PAIRS", 7), ("PIECE", 5), ("BROADCAST_GROUPS", 0)):
            monkeypatch.setattr(divergence, name, value)
    rows = audit_rows(seed, n, sources)
    found = divergence.audit(clashing(spark.createDataFrame(rows, DOCS).repartition(6)), top=5)
    assert sorted(tuple(r) for r in found.collect()) == audit_by_force(rows, 5)


def test_audit_odd_rows(spark):
    rows = [(i, "same words here", "en", "a") for i in range(4)] + [(9, None, "en", "b"), (10, "", "fr", "c"), (11, "alone", "fr", "d"), (12, "word " * 300_000, "en", None)]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(tuple(r) for r in divergence.audit(df).collect()) == audit_by_force(rows)
    assert divergence.audit(df.limit(0)).count() == 0
    assert divergence.audit(df.limit(0)).dtypes == divergence.audit(df).dtypes


def test_joint_histograms_cover_the_vocabulary(spark):
    """Each pair's cells, zeros included, hold every kept term of the language once."""
    rows = audit_rows(3, 150, 4)
    terms = divergence.vocabulary(divergence.counted(spark.createDataFrame(rows, DOCS))).cache()
    v = {r.lang: r["count"] for r in terms.groupBy("lang").count().collect()}
    kept = terms.select("lang", F.explode("cells.source").alias("source")).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("kept"))
    groups = kept.join(terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v")), "lang")
    cells = divergence.joint_histograms(terms, groups).where("m != 0").collect()
    sums = Counter()
    for r in cells:
        assert r.m > 0 and r.one < r.two
        sums[r.lang, r.one, r.two] += r.m
    assert sums and all(m == v[lang] for (lang, _, _), m in sums.items())


def test_tallies_pass_in_blocks(spark):
    """A task sends a row for each bucket of terms, not for each term of each group."""
    df = spark.createDataFrame(audit_rows(4, 300, 6), DOCS).repartition(3)
    assert 0 < divergence.counted(df).count() <= 3 * 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("entries, piece, buckets", [(400_000, 1 << 19, 1), (400_000, 1 << 19, 7), (30, 40, 5), (3, 1, 3)])
def test_blocks_by_force(monkeypatch, entries, piece, buckets):
    """Counts flushed early, texts cut in pieces, and several flushes of a term meet in its bucket."""
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    monkeypatch.setattr(divergence, "PIECE", piece)
    rows = [(lang or "", source or "", text or "") for _, text, lang, source in audit_rows(5, 120, 4)]
    rows += [("en", "s1", "x" * 200 + " " * 90 + "Ant,bee"), ("en", "s1", "ant"), ("en", "s2", "bee")]  # neighbours don't run together
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("text", pa.string())])
    tasks = [pa.Table.from_arrays([pa.array(c, pa.string()) for c in zip(*part, strict=True)], schema=kind).to_batches(max_chunksize=17) for part in (rows[:50], rows[50:])]
    blocks = pa.Table.from_batches([b for task in tasks for b in divergence._count(task, buckets)]).sort_by("bucket").combine_chunks()
    found = [r for b in divergence._merge(blocks.to_batches(max_chunksize=2), 3) for r in b.to_pylist()]
    words = [(lang, source, re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))) for lang, source, text in rows]
    docs = Counter((lang, x) for lang, _, w in words for x in set(w))
    n = Counter((lang, source, x) for lang, source, w in words for x in w)
    want = defaultdict(list)
    for (lang, source, x), m in sorted(n.items(), key=lambda e: e[0][1].encode()):
        if docs[lang, x] >= 3:
            want[lang, x].append({"source": source, "n": m})
    assert {(r["lang"], r["term"]): r["cells"] for r in found} == want
    assert len(found) == len(want) and all(r["total"] == sum(c["n"] for c in r["cells"]) for r in found)


@pytest.mark.parametrize("pairs, top, keys", [(1_000_000, 5, 1 << 63), (7, 5, 1 << 63), (40, 10**7, 1 << 63), (40, 5, 0)])
def test_joint_by_force(monkeypatch, pairs, top, keys):
    """Tallies of pairs, also folded and sent early, of terms with more pairs than are held, and of counts too many for one number."""
    monkeypatch.setattr(divergence, "PAIRS", pairs)
    monkeypatch.setattr(divergence, "KEYS", keys)
    rng = random.Random(6)
    rows = []
    for _ in range(60):
        at = sorted(rng.sample(range(10, 40), rng.choice([2, 3, 3, 12])))
        rows.append((rng.choice(["de", "en"]), [f"s{k}" for k in at], [rng.randint(1, top) for _ in at]))
    arrays = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())), strict=True)]
    batches = pa.Table.from_arrays(arrays, names=["lang", "sources", "counts"]).to_batches(max_chunksize=13)
    found = Counter()
    for b in divergence._joint(batches):
        for r in b.to_pylist():
            found[r["lang"], r["one"], r["two"], r["a"], r["b"]] += r["m"]
    want = Counter((lang, s[i], s[j], n[i], n[j]) for lang, s, n in rows for i in range(len(s)) for j in range(i + 1, len(s)))
    assert found == want


# Bounds and recall of the other operators.


def clusters(seed, n):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(500)}" for _ in range(90)] for _ in range(12)]
    texts = []
    for _ in range(n):
        words = list(rng.choice(base))
        if rng.random() < 0.5:
            words[rng.randrange(90)] = f"x{rng.randrange(9)}"
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("hot", [2048, 2])
def test_results_beyond_broadcast_bounds(spark, monkeypatch, hot):
    """With every bound at 0 and Spark's own broadcasts off, joins shuffle and give the same rows, also where groups of over two members are dealt over tasks."""
    from gridloom.llm import exact_dedup, frames, jaccard_join, mixing, substring_dedup, warc

    df = spark.createDataFrame([(i, t, "en", f"s{i % 5}") for i, t in enumerate(clusters(1, 150))], DOCS).repartition(4)
    texts = ["same", "same", None, "", "other", "same"]
    copies = spark.createDataFrame([(i, texts[i % 6], "en", [None, "", "hot", "hot"][i % 4]) for i in range(60)], DOCS).repartition(3)
    pages = df.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://x/"), F.col("doc_id")).alias("url"), F.col("text").alias("html"))
    runs = {
        "op1": lambda: warc.round_trip(pages),
        "op3": lambda: exact_dedup.mark_duplicates(df),
        "op3 kept": lambda: exact_dedup.drop_duplicates(copies),
        "op4": lambda: substring_dedup.remove_repeats(df, with_text=False),
        "op7": lambda: mixing.mix(df).select("doc_id", "source", "copy", "order_key"),
        "op7 odd": lambda: mixing.mix(copies).select("doc_id", "source", "copy", "order_key"),
        "op9": lambda: jaccard_join.join(df, n=3, num=90, den=100),
        "op13": lambda: divergence.audit(df),
    }
    rows = lambda run: sorted((tuple(r) for r in run().collect()), key=repr)
    want = {name: rows(run) for name, run in runs.items()}
    for module in (divergence, exact_dedup, jaccard_join, mixing, substring_dedup, warc):
        for name in [x for x in dir(module) if x.startswith("BROADCAST_")]:
            monkeypatch.setattr(module, name, 0)
    monkeypatch.setattr(frames, "HOT_ROWS", hot)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, run in runs.items():
            assert rows(run) == want[name], name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("dims", [32, 64, 128])
@pytest.mark.parametrize("hashes", [1, 2, 3, 4, 5])
def test_recall_of_vector_buckets(dims, hashes):
    """Pairs at a cosine of exactly 0.98 share a bucket, by the number of hashes that a table of vectors has."""
    import numpy as np

    from gridloom.llm import embedding_dedup

    rng = np.random.default_rng([dims, hashes])
    a, b = rng.normal(size=(2, 1000, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.98 * a + np.sqrt(1 - 0.98**2) * b
    group = np.zeros(1000, np.uint64)
    one, two = (embedding_dedup.bucket_keys(x, group, hashes) for x in (a, near))
    met = (one[:, :, None] == two[:, None, :]).any(axis=(1, 2)).mean()
    assert met >= (0.999 if hashes <= 3 else 0.995)


@pytest.mark.parametrize("plain", [0, 3])
def test_languages_are_fitted_on_whole_words(monkeypatch, plain):
    """Words of every length count alike, whether fitted side by side or in logarithms, over segments of the word."""
    from gridloom.llm import language_id

    pieces = {p: i for i, p in enumerate(["▁a", "a", "b", "ab", "ba", "aab", "▁ab"])}
    counts = {"x": Counter({"▁abab": 3, "▁aabba": 2, "▁" + "ab" * 12: 1, "▁c": 1}), "y": Counter({"▁ba": 4, "▁bbaab": 2})}
    want = language_id.fit(counts, pieces).probs
    monkeypatch.setattr(language_id, "PLAIN", plain)
    monkeypatch.setattr(language_id, "LONG_STEP", 5)
    assert language_id.fit(counts, pieces).probs == pytest.approx(want, rel=1e-9, abs=1e-15)
