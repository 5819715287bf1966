"""Streams in several micro-batches, in any order, resumed, and without input."""

import pytest
from pyspark.sql import functions as F

from lodegraph.sources import cbor
from lodegraph.streaming import generations

SCHEMA = "domain long, idx long, cid string, gone boolean"


def folder_of(spark, path, *files):
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/{n}")
    return f"{path}/*"


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0)])
def test_membership_in_any_order(spark, tmp_path, order):
    files = [[(1, 0, "a", False), (1, 0, "b", False)], [(1, 1, "a", True), (1, 1, "c", False)], [(1, 2, "a", False), (1, 2, "c", True), (1, 2, "b", True)]]
    path = folder_of(spark, str(tmp_path), *[files[i] for i in order])
    stream = generations.source(spark, path, spark.createDataFrame([], SCHEMA).schema, 1)
    assert {tuple(r) for r in generations.run(generations.membership(stream), "complete").collect()} == {(1, "a")}


def test_last_result_may_be_empty(spark, tmp_path):
    path = folder_of(spark, str(tmp_path), [(1, 0, "a", False)], [(1, 1, "a", True)])
    stream = generations.source(spark, path, spark.createDataFrame([], SCHEMA).schema, 1)
    assert generations.run(generations.membership(stream), "complete").count() == 0


def test_gaps_over_batches_and_resumption(spark, tmp_path):
    schema, out = spark.createDataFrame([], SCHEMA).schema, f"{tmp_path}/out"
    source = f"{tmp_path}/in"
    spark.createDataFrame([(1, 0, "", False), (1, 1, "", False), (2, 5, "", False)], SCHEMA).coalesce(1).write.parquet(source)
    gaps = lambda: generations.sequence_gaps(generations.source(spark, source, schema).select("domain", "idx"))
    assert not [r for r in generations.run(gaps(), folder=out).collect() if r["gap"]]
    spark.createDataFrame([(1, 3, "", False), (2, 6, "", False)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    found = {(r["domain"], r["idx"]): (r["expected"], r["gap"]) for r in generations.run(gaps(), folder=out).collect()}
    assert len(found) == 5 and found[1, 3] == (2, True) and found[2, 6] == (6, False)


def test_no_input(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stream = generations.source(spark, str(tmp_path / "none"), spark.createDataFrame([], SCHEMA).schema)
    assert generations.run(generations.membership(stream), "complete").count() == 0
    assert generations.run(stream).count() == 0


def test_arrivals(spark, tmp_path):
    good = cbor.encode({"pub": "1", "type": "t", "created": "x", "author": "a", "body": {}})
    spark.createDataFrame([("p", bytearray(good)), ("q", bytearray(b"\xff"))], "path string, content binary").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("path string, content binary").parquet(f"{tmp_path}/in")
    got = {r["path"]: r["ok"] for r in generations.run(generations.arrivals(stream).select("path", "ok", F.col("fault"))).collect()}
    assert got == {"p": True, "q": False}
