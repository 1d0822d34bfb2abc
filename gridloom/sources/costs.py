"""Cost tables from and to CSV, JSON and Excel files.

A cost file is a table for people to edit, so it is read on the driver; the text comes through
Spark, from any store.
"""

from __future__ import annotations

import csv
import io
import json
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from gridloom.errors import FileLoadError, FormatError, InvalidSourceError
from gridloom.operators.costs import CostTable, detect_features, table_to_costs, zero_costs
from gridloom.session import place

# What is tried in turn.
ENCODINGS = ("utf-8", "latin-1", "ISO-8859-1", "cp1252")
DELIMITERS = (",", ";", "\t", "|")
JOINER = "__"


def read_bytes(spark: SparkSession, path: str) -> bytes:
    try:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    except Exception as cause:  # Spark has many kinds for a file it can't read
        raise FileLoadError(f"{path} can't be read") from cause


def load(spark: SparkSession, source: object) -> CostTable:
    """A cost table from a mapping, a file, a table of costs or a DataFrame."""
    if isinstance(source, CostTable):
        return source
    if isinstance(source, Mapping):
        return CostTable.from_dict(spark, source)
    if isinstance(source, DataFrame):
        return table_to_costs(spark, source)
    if not isinstance(source, str | os.PathLike):
        raise InvalidSourceError(f"not a source of costs: {type(source).__name__}")
    name = os.fspath(source).lower()
    if name.endswith(".csv"):
        return load_csv(spark, os.fspath(source))
    if name.endswith(".json"):
        return load_json(spark, os.fspath(source))
    if name.endswith((".xlsx", ".xls")):
        return load_excel(spark, os.fspath(source))
    raise InvalidSourceError(f"not a cost file: {source}")


def _number(text: str, decimal: str) -> float | None:
    try:
        return float(text.strip().replace(decimal, ".")) if decimal == "." or "." not in text else None
    except ValueError:
        return None


def _from_table(spark: SparkSession, header: list[str], rows: list[list[str]], decimal: str) -> CostTable | None:
    """The first column whose filled cells are all numbers is the cost; None if there is none."""
    filled = [[r[i] for r in rows if i < len(r) and r[i].strip()] for i in range(len(header))]
    cost = next((i for i, c in enumerate(filled) if c and all(_number(x, decimal) is not None for x in c)), None)
    if cost is None or len(header) < 2:
        return None
    keys = [i for i in range(len(header)) if i != cost]
    latest: dict[tuple, float | None] = {}
    for r in rows:
        r = r + [""] * (len(header) - len(r))
        key = tuple(r[i].strip() for i in keys)
        latest.pop(key, None)
        latest[key] = _number(r[cost], decimal) if r[cost].strip() else None
    return CostTable.from_rows(
        spark,
        header[keys[0]],
        [header[i] for i in keys[1:]],
        [(*k, v) for k, v in latest.items()],
        "tuple" if len(keys) > 1 else "simple",
    )


def load_csv(spark: SparkSession, path: str) -> CostTable:
    """Encodings, delimiters (the sniffed one first) and decimal marks in turn; the first that fit win."""
    data = read_bytes(spark, path)
    for encoding in ENCODINGS:
        try:
            text = data.decode(encoding).lstrip("﻿")
        except UnicodeDecodeError:
            continue
        try:
            sniffed = [csv.Sniffer().sniff(text, "".join(DELIMITERS)).delimiter]
        except csv.Error:
            sniffed = []
        for delimiter in dict.fromkeys([*sniffed, *DELIMITERS]):
            rows = [r for r in csv.reader(io.StringIO(text), delimiter=delimiter) if any(x.strip() for x in r)]
            if len(rows) < 2 or len(rows[0]) < 2:
                continue
            for decimal in (".", ","):
                if (found := _from_table(spark, [h.strip() for h in rows[0]], rows[1:], decimal)) is not None:
                    return found
    raise FileLoadError(f"{path} holds no cost table")


def load_json(spark: SparkSession, path: str) -> CostTable:
    """The format with metadata, or a plain mapping whose features are not named."""
    try:
        doc = json.loads(read_bytes(spark, path).decode("utf-8"))
    except ValueError as cause:
        raise FileLoadError(f"{path} is not JSON") from cause
    if not isinstance(doc, dict) or not doc:
        raise FileLoadError(f"{path} is empty")
    if "metadata" in doc:
        meta = doc["metadata"]
        main, sides = meta.get("main_feature"), meta.get("side_features") or []
        costs = doc.get("cost_assumptions") or {}
        if not costs:
            raise FileLoadError(f"{path} holds no costs")
        if any(JOINER in k for k in costs) and sides:
            costs = {tuple(k.split(JOINER)): v for k, v in costs.items()}
        return CostTable.from_dict(spark, {(main, *sides) if sides else main: costs})
    first = next(iter(doc.values()))
    if isinstance(first, dict):
        rows = [(m, s, c) for m, v in doc.items() for s, c in (v.items() if isinstance(v, dict) else [("", v)])]
        return CostTable.from_rows(spark, "", [""], rows, "nested")
    return CostTable.from_rows(spark, "", [], list(doc.items()), "simple")


def load_excel(spark: SparkSession, path: str) -> CostTable:
    """The first sheet; needs openpyxl, which is optional."""
    import pandas as pd

    try:
        table = pd.read_excel(io.BytesIO(read_bytes(spark, path)), dtype=str).fillna("")
    except ImportError as cause:
        raise FileLoadError("Excel files need openpyxl") from cause
    rows = table.values.tolist()
    for decimal in (".", ","):
        if (found := _from_table(spark, [str(c) for c in table.columns], rows, decimal)) is not None:
            return found
    raise FormatError(f"{path} has no numeric column")


def _rows(costs: CostTable) -> tuple[list[str], list[list]]:
    rows = costs.table.orderBy("ord").collect()  # a table for people
    return [costs.main, *costs.sides, "cost"], [[*(r[k] for k in costs.keys), r["cost"]] for r in rows]


def save_csv(costs: CostTable, path: str, decimal: str = ".", delimiter: str = ";", encoding: str = "ISO-8859-1") -> None:
    header, rows = _rows(costs)
    text = io.StringIO(newline="")
    out = csv.writer(text, delimiter=delimiter)
    out.writerow(header)
    out.writerows([*r[:-1], "" if r[-1] is None else str(r[-1]).replace(".", decimal)] for r in rows)
    _write(path, text.getvalue().encode(encoding))


def _write(path: str, data: bytes) -> None:
    system, name = place(path)
    with system.open_output_stream(name) as file:
        file.write(data)


def save_json(costs: CostTable, path: str) -> None:
    values = next(iter(costs.to_dict().values()))
    plain = {JOINER.join(k) if isinstance(k, tuple) else k: v for k, v in values.items()}
    doc = {"metadata": {"main_feature": costs.main, "side_features": list(costs.sides)}, "cost_assumptions": plain}
    _write(path, json.dumps(doc, indent=2, ensure_ascii=False).encode())


def save_excel(costs: CostTable, path: str) -> None:
    import pandas as pd

    header, rows = _rows(costs)
    pd.DataFrame(rows, columns=header).to_excel(path, index=False)


def save(costs: CostTable, path: str) -> None:
    for ending, how in ((".csv", save_csv), (".json", save_json), (".xlsx", save_excel), (".xls", save_excel)):
        if path.lower().endswith(ending):
            return how(costs, path)
    raise TypeError(f"not a cost file: {path}")


def save_template(features: DataFrame, path: str, main: str | None = None, sides: list[str] | None = None) -> CostTable:
    """Find the features (unless named), and save a table of their values with costs of 0."""
    if main is None:
        main, sides = detect_features(features)
    rows = [tuple(r) for r in zero_costs(features, main, sides or ()).orderBy(main, *(sides or [])).collect()]
    costs = CostTable.from_rows(features.sparkSession, main, sides or [], rows, "tuple" if sides else "simple")
    save(costs, path)
    return costs
