"""Version streams over restarts and failures, deliveries to subscribers, statements with named parameters."""

import json

import pytest
from pyspark.sql import functions as F

from waymark.operators import named
from waymark.sources import sinks
from waymark.streaming import versions


def drop(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / f".{name}").write_text("\n".join(map(json.dumps, rows)))
    (folder / f".{name}").rename(folder / f"{name}.json")


def test_a_failed_build_keeps_the_old_version_and_is_tried_again(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in ("root", "seen", "log")}
    state = {"fails": True, "built": []}

    def build(service, version):
        state["built"].append(version)
        if version == "v2" and state["fails"]:
            raise RuntimeError("no space")
        return {"t": spark.createDataFrame([(version,)], "v string")}

    def run(name, *rows):
        drop(tmp_path / "events", name, *rows)
        versions.keep_current(spark, str(tmp_path / "events"), at["root"], build, at["seen"], at["log"]).awaitTermination()
        return sinks.current_version(spark, f"{at['root']}/s")

    tick = lambda v: {"service": "s", "kind": "tick", "version": v}
    demand = {"service": "s", "kind": "demand"}
    assert run("a", tick("v1")) == "v1"
    assert run("b", tick("v2")) == "v1"
    assert sinks.load_snapshot(spark, f"{at['root']}/s", ["t"])["t"].first()["v"] == "v1"
    assert run("c", demand) == "v1"  # fails again
    state["fails"] = False
    assert run("d", demand) == "v2"
    assert run("e", demand, tick("v0")) == "v2"  # an older version changes nothing
    assert state["built"] == ["v1", "v2", "v2", "v2"]
    log = spark.read.schema(versions.LOG).parquet(f"{at['log']}/at=*").orderBy("batch").collect()
    assert [(r["outcome"], r["ticks"], r["demands"]) for r in log] == [("published", 1, 0), ("failed", 2, 0), ("failed", 2, 1), ("published", 2, 2), ("current", 3, 3)]


def test_late_subscribers_get_the_current_version_once_and_then_changes(spark, tmp_path):
    moment = lambda h: f"2024-01-01T{h:02}:00:00.000Z"
    note = lambda kind, who, h: {"kind": kind, "who": who, "at": moment(h)}

    def run(name, *rows):
        drop(tmp_path / "notes", name, *rows)
        versions.deliver(spark, str(tmp_path / "notes"), str(tmp_path / "store"), str(tmp_path / "seen")).awaitTermination()
        got = spark.read.parquet(str(tmp_path / "store" / "deliveries")).orderBy("subscriber", "at")
        return [(r["subscriber"], r["version"]) for r in got.collect()]

    early = run("a", note("subscribe", "ann", 1))
    assert early == []
    assert run("b", note("version", "v1", 2), note("version", "v2", 4), note("subscribe", "bob", 3)) == [("ann", "v1"), ("ann", "v2"), ("bob", "v1"), ("bob", "v2")]
    assert run("c", note("subscribe", "cid", 5), note("subscribe", "bob", 5)) == [("ann", "v1"), ("ann", "v2"), ("bob", "v1"), ("bob", "v2"), ("cid", "v2")]
    assert run("d", note("version", "v2", 6), note("version", "v3", 7)) == [("ann", "v1"), ("ann", "v2"), ("ann", "v3"), ("bob", "v1"), ("bob", "v2"), ("bob", "v3"), ("cid", "v2"), ("cid", "v3")]


def test_named_parameters(spark):
    t = spark.createDataFrame([(1, "a:x"), (2, "it's"), (3, None)], "id bigint, name string")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(named.run(spark, "select id from {t} where name = :n", {"n": "it's"}, t=t)) == [2]
    assert ids(named.run(spark, "select id from {t} where name = 'a:x' /* :n */ and id = :n -- :n", {"n": "1"}, {"n": "int"}, t=t)) == [1]
    assert ids(named.run(spark, "select id from {t} where array_contains(:ids, id)", {"ids": {3, 1}}, {"ids": "array<bigint>"}, t=t)) == [1, 3]
    assert ids(named.run(spark, "select id from {t} where array_contains(:ids, id)", {"ids": []}, {"ids": "array<bigint>"}, t=t)) == []
    assert ids(named.run(spark, "select id from {t} where :n is null or id::int = :n", {"n": None}, {"n": "int"}, t=t)) == [1, 2, 3]
    assert named.value(spark, "select max(id) from {t}", t=t) == 3 and named.value(spark, "select id from {t} where id > :n", {"n": 5}, t=t) is None
    with pytest.raises(ValueError):
        named.value(spark, "select id from {t}", t=t)
    with pytest.raises(ValueError):
        named.run(spark, "select 1", {}, {"n": "int"})
    with pytest.raises(Exception, match="(?i)unbound"):
        named.run(spark, "select :missing").collect()


def test_a_parameter_reaches_the_scan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    found = named.run(spark, "select o_orderkey from {orders} where o_orderkey > :low", {"low": 10}, orders=orders)
    assert "GreaterThan(o_orderkey,10)" in found._jdf.queryExecution().toString()
    assert found.where(F.col("o_orderkey") <= 10).count() == 0
