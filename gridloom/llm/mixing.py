"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the output over its share of
the input. Each document draws its number of copies from a Poisson distribution with
that mean: a uniform number from a hash of seed and id is put through the inverse
distribution, so draws need no state and repeat exactly. A large mean is drawn as the sum of
several draws of smaller means, which has the same distribution. Copies are then shuffled
globally by a second hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.frames import attach

SEED = "mix-1"
#: Sources up to which their rates are broadcast (at most 800 numbers each, so 32 MB); beyond, documents are joined by shuffling, those of large sources over several tasks.
BROADCAST_SOURCES = 5_000
#: Sources weigh as this power of their size unless weights are given.
TEMPERATURE = 0.5
#: The highest mean of one draw (exp(-mean) underflows from about 745); larger rates are drawn in equal parts.
MAX_RATE = 500.0
#: Copies of a row that are made at a time.
COPIES = 4096


def uniform(seed: str, *columns: Column) -> Column:
    """A number of [0, 1) from the first 13 hex digits of an MD5."""
    key = F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def rates(
    docs: DataFrame,
    source_col: str = "source",
    text_col: str = "text",
    weights: dict[str, float] | None = None,
    size: float = 1.0,
) -> DataFrame:
    """source, chars, docs, rate: one row for each source (null is a source of its own).

    The output holds ``size`` times the input's characters, shared by ``weights``
    (any positive scale; sources without one get none), or by each source's characters
    to the power TEMPERATURE. Sources without characters get the rate 0.
    """
    chars = F.coalesce(F.length(text_col), F.lit(0)).cast("long")
    sums = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(chars).alias("chars"), F.count(F.lit(1)).alias("docs"))
    if weights is None:
        weight = F.pow(F.col("chars").cast("double"), F.lit(TEMPERATURE))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
        weight = F.when(F.col("chars") > 0, weight).otherwise(F.lit(0.0))
    sums = sums.withColumn("weight", weight)
    totals = sums.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    rate = F.col("weight") / F.col("all_weight") * F.col("all_chars") * F.lit(float(size)) / F.col("chars")
    return sums.crossJoin(F.broadcast(totals)).select(
        "source",
        "chars",
        "docs",
        F.coalesce(F.when(F.col("chars") > 0, rate), F.lit(0.0)).alias("rate"),
    )


def distribution(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson distribution, far past its last step in double precision."""
    start = F.struct(F.exp(-rate).alias("term"), F.exp(-rate).alias("total"), F.array(F.exp(-rate)).alias("steps"))

    def step(state: Column, k: Column) -> Column:
        term = state["term"] * rate / k
        total = state["total"] + term
        return F.struct(term.alias("term"), total.alias("total"), F.concat(state["steps"], F.array(total)).alias("steps"))

    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["steps"])


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: dict[str, float] | None = None,
    size: float = 1.0,
    seed: str = SEED,
) -> DataFrame:
    """``docs`` with each row repeated, shuffled globally; adds copy (int, from 0) and order_key.

    Rows with equal ids draw the same number; a null id draws as an id of its own. Null or
    empty texts count no characters but are drawn at their source's rate. Columns named
    copy or order_key are replaced. An empty table stays empty.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_RATE).cast("int"))
    named = lambda source: {"_none": source.isNull(), "_source": F.coalesce(source.cast("string"), F.lit(""))}
    steps = rates(docs, source_col, text_col, weights, size).withColumn("_draws", parts).withColumns(named(F.col("source")))
    steps = steps.select("_none", "_source", "docs", "_draws", distribution(F.col("rate") / F.col("_draws")).alias("_steps"))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    names = [c for c in docs.columns if c not in ("copy", "order_key")]
    rows = docs.select(
        *[c.alias(name) for name, c in named(F.col(source_col)).items()],
        key.alias("key"),
        uniform(seed, key).alias("draw"),
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
    )
    drawn = attach(rows, steps, ["_none", "_source"], [F.col("key")], "inner", "docs", BROADCAST_SOURCES)
    count = lambda draw: F.size(F.filter("_steps", lambda s: draw >= s))
    more = F.transform(F.sequence(F.lit(1), F.col("_draws") - 1), lambda i: uniform(f"{seed}-part", i, F.col("key")))
    more = F.when(F.col("_draws") > 1, F.aggregate(more, F.lit(0), lambda n, draw: n + count(draw))).otherwise(0)
    drawn = drawn.withColumn("n", count(F.col("draw")) + more).where("n > 0")
    drawn = drawn.select("row", "key", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(COPIES))).alias("first"))
    last = F.least(F.col("n"), F.col("first") + COPIES) - 1
    out = drawn.select("row", "key", F.explode(F.sequence(F.col("first"), last)).alias("copy"))
    out = out.withColumn("order_key", F.md5(F.concat_ws("|", F.lit(seed + "-order"), F.col("key"), F.col("copy").cast("string"))))
    out = out.repartitionByRange("order_key").sortWithinPartitions("order_key", "key")
    return out.select("row.*", "copy", "order_key")


def mix_sql(seed: str = SEED, table: str = "documents") -> str:
    """The same draws in DuckDB's SQL: doc_id, source, copy, order_key."""
    return f"""
WITH RECURSIVE sums AS (SELECT source, sum(coalesce(length(text), 0))::BIGINT AS chars FROM {table} GROUP BY source),
weighted AS (SELECT source, chars, pow(chars::DOUBLE, {TEMPERATURE}) AS weight FROM sums),
totals AS (SELECT sum(chars)::DOUBLE AS all_chars, sum(weight) AS all_weight FROM weighted),
by_source AS (SELECT source, rate, greatest(1, ceil(rate / {MAX_RATE}))::INTEGER AS parts FROM (
  SELECT source, CASE WHEN chars > 0 THEN weight / all_weight * all_chars * 1.0 / chars ELSE 0.0 END AS rate FROM weighted, totals)),
means AS (SELECT source, rate / parts AS rate FROM by_source),
steps(source, rate, k, term, total) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM means
  UNION ALL SELECT source, rate, k + 1, term * rate / (k + 1), total + term * rate / (k + 1) FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
keyed AS (SELECT row_number() OVER () AS row_id, doc_id, source, coalesce(doc_id::VARCHAR, 'null') AS key FROM {table}),
draws AS (
  SELECT k.*, ('0x' || substr(md5('{seed}|' || key), 1, 13))::BIGINT::DOUBLE / {1 << 52} AS u FROM keyed k
  UNION ALL SELECT k.*, ('0x' || substr(md5('{seed}-part|' || i::VARCHAR || '|' || key), 1, 13))::BIGINT::DOUBLE / {1 << 52}
  FROM keyed k JOIN by_source b ON k.source IS NOT DISTINCT FROM b.source, LATERAL (SELECT unnest(range(1, b.parts)) AS i)),
numbers AS (SELECT d.row_id, any_value(d.doc_id) AS doc_id, any_value(d.source) AS source, any_value(d.key) AS key, count(*) AS n
  FROM draws d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND d.u >= s.total GROUP BY d.row_id),
counted AS (SELECT doc_id, source, key, unnest(range(0, n)) AS copy FROM numbers)
SELECT doc_id, source, copy::INTEGER AS copy, md5('{seed}-order|' || key || '|' || copy::VARCHAR) AS order_key FROM counted"""
