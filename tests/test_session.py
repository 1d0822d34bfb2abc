import importlib.util
import os
import sys
from types import SimpleNamespace

import pytest

from gridloom import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def entry_module():
    spec = importlib.util.spec_from_file_location("entry_under_test", f"{ROOT}/__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_release_deletes_the_tables_of_a_scope(spark):
    other = session.store(spark.range(7), "numbers")
    with session.scope("mine"):
        kept = session.store(spark.range(5), "numbers")
    later = session.store(spark.range(3), "numbers")
    assert kept.count() == 5 and kept.inputFiles()
    session.release(spark, "mine")
    assert other.count() == 7 and later.count() == 3
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(os.path.dirname(kept.inputFiles()[0])).count()


def test_a_cluster_needs_a_shared_folder():
    conf = {}
    fake = SimpleNamespace(
        conf=SimpleNamespace(get=conf.get),
        sparkContext=SimpleNamespace(master="spark://head:7077", applicationId="app-fake"),
    )
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(fake)
    conf["spark.checkpoint.dir"] = "hdfs://head/work/"
    assert session.shared_dir(fake) == "hdfs://head/work"


def test_stored_empty_table_keeps_its_schema(spark):
    empty = spark.range(5).where("id > 9").selectExpr("id", "array(id) as list")
    assert session.store(empty, "empty").schema.simpleString() == empty.schema.simpleString()


def test_entry_without_the_corpus_part(monkeypatch):
    full = entry_module()
    for name in ("gridloom.llm", "gridloom.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    bare = entry_module()
    assert bare._llm is None and bare._pipeline is None
    assert bare.queries().keys() <= full.queries().keys() and "sssp_r1" in bare.queries()
    assert bare.oracle_sql().keys() <= bare.queries().keys()


def test_entry_does_not_hide_other_errors(monkeypatch):
    monkeypatch.setitem(sys.modules, "gridloom.plans", None)
    with pytest.raises(ImportError):
        entry_module()


def test_every_sql_has_its_query():
    module = entry_module()
    assert module.oracle_sql().keys() <= module.queries().keys()
    assert all(callable(q) for q in module.queries().values())
