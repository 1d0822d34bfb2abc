"""Cost tables: applying them to features, and finding the columns that fit them.

A cost table is a DataFrame ``ord long, main string, side1..n string, cost double``; '' in
a side column stands for anything. Tables are small (a row for each kind of land use) and
are joined as Spark sees fit; features are never collected.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.errors import FormatError, InvalidSourceError, NoSuitableColumnsError

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
#: Columns that never describe a feature.
IGNORED = ("geometry", "id", "fid", "gid", "oid")


@dataclass(frozen=True)
class CostTable:
    """Costs by a main feature and any number of side features.

    layout: simple (main only), tuple (all columns must agree, with wildcards), or nested (one side
    feature, '' being the main feature's default).
    """

    table: DataFrame
    main: str
    sides: tuple[str, ...] = ()
    layout: str = "simple"

    @classmethod
    def from_dict(cls, spark: SparkSession, costs: Mapping) -> CostTable:
        """{main: {value: cost}}, {(main, side, ...): {(value, ...): cost}} or {(main, side): {value: {value: cost}}}.

        Only the first item counts.
        """
        if not isinstance(costs, Mapping) or not costs:
            raise InvalidSourceError("costs must be a mapping with a feature as its key")
        key, values = next(iter(costs.items()))
        if not isinstance(values, Mapping):
            raise InvalidSourceError("a feature's costs must be a mapping")
        main, *sides = key if isinstance(key, tuple) else (key,)
        if values and isinstance(next(iter(values)), tuple):
            layout, rows = "tuple", [(*k, v) for k, v in values.items()]
        elif sides and any(isinstance(v, Mapping) for v in values.values()):
            layout, rows = "nested", [(m, s, c) for m, v in values.items() for s, c in (v.items() if isinstance(v, Mapping) else [("", v)])]
        else:
            layout, sides, rows = "simple", [], list(values.items())
        return cls.from_rows(spark, main, sides, rows, layout)

    @classmethod
    def from_rows(cls, spark: SparkSession, main: str, sides: Sequence[str], rows: Sequence[Sequence], layout: str) -> CostTable:
        width = len(sides) + 2
        names = ["main", *(f"side{i + 1}" for i in range(len(sides)))]
        schema = ", ".join(["ord long", *(f"{n} string" for n in names), "cost double"])
        data = []
        for i, row in enumerate(rows):
            if len(row) != width:
                raise FormatError(f"{row!r} does not have {width} fields")
            data.append((i, *("" if v is None else str(v) for v in row[:-1]), None if row[-1] is None else float(row[-1])))
        return cls(spark.createDataFrame(data, schema), main, tuple(sides), layout)

    @property
    def keys(self) -> list[str]:
        return ["main", *(f"side{i + 1}" for i in range(len(self.sides)))]

    def to_dict(self) -> dict:
        """The mapping that ``from_dict`` takes; the table is small by nature."""
        rows = self.table.orderBy("ord").collect()
        name = (self.main, *self.sides) if self.sides else self.main
        if self.layout == "tuple":
            return {name: {tuple(r[k] for k in self.keys): r["cost"] for r in rows}}
        if self.layout == "nested":
            out: dict = {}
            for r in rows:
                out.setdefault(r["main"], {})[r["side1"]] = r["cost"]
            return {name: out}
        return {name: {r["main"]: r["cost"] for r in rows}}


def _text(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))


def _latest(table: DataFrame, *keys: Column) -> DataFrame:
    """Of rows with equal keys the cost of the last one."""
    return table.groupBy(*keys).agg(F.max_by("cost", "ord").alias("_cost"))


def apply_costs(features: DataFrame, costs: CostTable) -> DataFrame:
    """``features`` with a column ``cost``; null where nothing matches.

    Null attributes match as ''. simple: the main feature's cost, whatever cost there was
    before. tuple: an exact match of all columns, else the former cost, else the
    last wildcard row of the main feature. nested: the side feature's cost, else the
    main feature's default where the side is empty or not listed for it.
    """
    if not costs.main:
        raise FormatError("the cost table names no main feature")
    if costs.layout == "nested" and len(costs.sides) != 1:
        raise FormatError("nested costs need exactly one side feature")
    names = [costs.main, *costs.sides]
    if missing := [n for n in names if n not in features.columns]:
        raise FormatError(f"the features have no column {', '.join(missing)}")
    # All attributes as one struct, so that no name can clash.
    rows = features.select(
        F.struct(*[F.col(f"`{c}`") for c in features.columns if c != "cost"]).alias("row"),
        *[_text(n).alias(k) for n, k in zip(names, costs.keys, strict=True)],
        (F.col("cost").cast("double") if "cost" in features.columns else F.lit(None).cast("double")).alias("prior"),
    )
    table = costs.table
    exact = _latest(table, *map(F.col, costs.keys))
    if costs.layout == "simple":
        out = rows.join(_latest(table, F.col("main")), "main", "left").select("row.*", F.col("_cost").alias("cost"))
    elif costs.layout == "tuple":
        open_ = F.lit(False)
        for k in costs.keys:
            open_ = open_ | (F.col(k) == "")
        wild = _latest(table.where(open_), F.col("main")).withColumnRenamed("_cost", "_wild")
        out = rows.join(exact, costs.keys, "left").join(wild, "main", "left").select(
            "row.*",
            F.coalesce("_cost", "prior", "_wild").alias("cost"),
        )
    elif costs.layout == "nested":
        default = _latest(table.where("side1 = ''"), F.col("main")).withColumnRenamed("_cost", "_default")
        out = rows.join(exact.where("side1 <> ''"), ["main", "side1"], "left").join(default, "main", "left").select("row.*", F.coalesce("_cost", "_default").alias("cost"))
    else:
        raise FormatError(f"no such layout: {costs.layout}")
    return out


def to_numbers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns as doubles where that loses no value: as they are, or with a decimal comma."""
    texts = [c for c in columns or df.columns if isinstance(df.schema[c].dataType, T.StringType)]
    if not texts:
        return df
    plain = {c: F.expr(f"try_cast(trim(`{c}`) as double)") for c in texts}
    comma = {c: F.expr(f"try_cast(replace(trim(`{c}`), ',', '.') as double)") for c in texts}
    lost = df.agg(*[F.sum((F.col(f"`{c}`").isNotNull() & how[c].isNull()).cast("long")).alias(f"{n}{i}") for n, how in (("p", plain), ("c", comma)) for i, c in enumerate(texts)]).first()
    chosen = {c: plain[c] if not lost[f"p{i}"] else comma[c] for i, c in enumerate(texts) if not lost[f"p{i}"] or not lost[f"c{i}"]}
    return df.withColumns(chosen) if chosen else df


def table_to_costs(spark: SparkSession, df: DataFrame, ordinal: str | None = None) -> CostTable:
    """A cost table from any table: its first numeric column is the cost, all others are keys.

    Of rows with equal keys the last one by ``ordinal`` counts (else by the order of reading).
    """
    fields = [f for f in df.schema.fields if f.name != ordinal]
    cost = next((f.name for f in fields if isinstance(f.dataType, NUMERIC)), None)
    if cost is None:
        raise FormatError("no numeric column")
    keys = [f.name for f in fields if f.name != cost]
    if not keys:
        raise FormatError("no key column")
    order = F.col(ordinal) if ordinal else F.monotonically_increasing_id()
    names = ["main", *(f"side{i + 1}" for i in range(len(keys) - 1))]
    rows = df.select(
        order.cast("long").alias("ord"),
        *[_text(k).alias(n) for k, n in zip(keys, names, strict=True)],
        F.col(f"`{cost}`").cast("double").alias("cost"),
    )
    rows = rows.groupBy(*names).agg(F.max("ord").alias("ord"), F.max_by("cost", "ord").alias("cost")).select("ord", *names, "cost")
    return CostTable(rows, keys[0], tuple(keys[1:]), "tuple" if len(keys) > 1 else "simple")


def zero_costs(features: DataFrame, main: str, sides: Sequence[str] = ()) -> DataFrame:
    """A template: the distinct values with a cost of 0 (null as '')."""
    return features.select(_text(main).alias(main), *[_text(s).alias(s) for s in sides]).distinct().withColumn("cost", F.lit(0.0))


def column_statistics(features: DataFrame, columns: Sequence[str] | None = None, area: Column | None = None) -> DataFrame:
    """column, n, nulls, n_distinct, null_ratio, is_good, count_entropy, area_entropy.

    Left out are columns that are ignored by name, numeric ones of more than 20 values, and any of
    more than 50. Entropies in bits; that of counts over all rows, that of areas over the
    rows with a value. One pass over the features for all columns: they are unpivoted and grouped once.
    """
    names = [c for c in columns or features.columns if c.lower() not in IGNORED and isinstance(
        features.schema[c].dataType,
        (T.StringType, T.BooleanType, *NUMERIC),
    )]
    schema = "column string, n long, nulls long, n_distinct long, null_ratio double, is_good boolean, count_entropy double, area_entropy double"
    if not names:
        return features.sparkSession.createDataFrame([], schema)
    numeric = [c for c in names if isinstance(features.schema[c].dataType, NUMERIC)]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in names])
    long = features.select(
        F.explode(pairs).alias("p"),
        (area if area is not None else F.lit(0.0)).alias("area"),
    ).select("p.column", "p.value", "area")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("k"), F.sum("area").alias("area"))
    known = F.col("value").isNotNull()
    sums = counts.groupBy("column").agg(F.sum("k").alias("n"), F.sum(F.when(known, F.col("area"))).alias("all_area"))
    p = F.col("k") / F.col("n")
    q = F.when(known & (F.col("all_area") > 0), F.col("area") / F.col("all_area"))
    found = counts.join(sums, "column").groupBy("column").agg(
        F.max("n").alias("n"),
        F.coalesce(F.sum(F.when(~known, F.col("k"))), F.lit(0)).alias("nulls"),
        F.count(F.when(known, F.lit(1))).alias("n_distinct"),
        F.coalesce(-F.sum(F.when(known, p * F.log2(p))), F.lit(0.0)).alias("count_entropy"),
        F.coalesce(-F.sum(F.when(q > 0, q * F.log2(q))), F.lit(0.0)).alias("area_entropy"),
    )
    found = found.withColumn("null_ratio", F.col("nulls") / F.col("n"))
    good = (F.col("n_distinct") > 1) & (F.col("n_distinct") < 0.3 * F.col("n")) & (F.col("null_ratio") < 0.2)
    found = found.withColumn("is_good", good)
    out = found.where(~(F.col("column").isin(numeric) & (F.col("n_distinct") > 20)) if numeric else F.lit(True)).where("n_distinct <= 50")
    return out.select("column", "n", "nulls", "n_distinct", "null_ratio", "is_good", "count_entropy", "area_entropy")


def ranked_columns(statistics: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """column, score, ord: good columns (all, if none is good), by 0.7 area and 0.3 count entropy."""
    any_good = statistics.agg(F.coalesce(F.max("is_good"), F.lit(False)).alias("_any"))
    place = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in order]), F.col("column")), F.lit(0)) if order else F.lit(0)
    score = 0.7 * F.col("area_entropy") + 0.3 * F.col("count_entropy")
    rows = statistics.crossJoin(F.broadcast(any_good)).where("is_good or not _any")  # one row
    return rows.select("column", score.alias("score"), place.alias("ord"))


def relation(features: DataFrame, main: str, side: str) -> bool:
    """Whether a side feature tells more about a main feature.

    Not if it has more than 100 values or none. Else if the table of both is filled by more than a
    twentieth, if some main value has several side values, or if an empty side value splits one.
    """
    counts = features.where(F.col(f"`{main}`").isNotNull()).groupBy(
        F.col(f"`{main}`").alias("m"),
        F.col(f"`{side}`").alias("s"),
    ).count().where("s is not null")
    by_main = counts.groupBy("m").agg(F.count(F.lit(1)).alias("k"))
    got = by_main.agg(F.count(F.lit(1)).alias("rows"), F.sum("k").alias("cells"), F.max("k").alias("most")).first()
    columns = counts.select("s").distinct().count()
    if not columns or columns > 100 or not got["rows"]:
        return False
    return bool(got["cells"] / (got["rows"] * columns) > 0.05 or got["most"] >= 2)


def side_features(features: DataFrame, main: str, statistics: DataFrame) -> list[str] | None:
    """Columns of a null ratio up to 0.7 that are related to the main one, by falling count entropy."""
    rows = statistics.where((F.col("null_ratio") <= 0.7) & (F.col("column") != main)).orderBy(F.desc("count_entropy"), "column").collect()  # one for each column
    return [r["column"] for r in rows if relation(features, main, r["column"])] or None


def detect_features(features: DataFrame, area: Column | None = None) -> tuple[str, list[str] | None]:
    """(main feature, side features or None)."""
    statistics = column_statistics(features, area=area).cache()
    try:
        top = ranked_columns(statistics, features.columns).orderBy(F.desc("score"), "ord", "column").limit(1).collect()
        if not top:
            raise NoSuitableColumnsError("no column can be the main feature")
        main = top[0]["column"]
        return main, side_features(features, main, statistics)
    finally:
        statistics.unpersist()


def entropy(counts: Sequence[float]) -> float:
    total = sum(counts)
    return -sum(c / total * math.log2(c / total) for c in counts if c)
