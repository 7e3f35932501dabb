"""Edits of a folder of scripts, and the tokens that follow them."""

import os

from pyspark.sql import functions as F

from sceneloom.operators import scanner
from sceneloom.sources import scenes
from sceneloom.streaming import changes


def test_edited_files_replace_their_tokens(spark, tmp_path):
    scripts, sink = tmp_path / "scripts", str(tmp_path / "sink")
    scripts.mkdir()
    clock = iter(range(1_700_000_000, 1_800_000_000))

    def put(name, text):
        (scripts / f"{name}.txt").write_text(text)
        t = next(clock)
        os.utime(scripts / f"{name}.txt", (t, t))

    def check(query, **texts):
        query.processAllAvailable()
        expected = scanner.scan(spark.createDataFrame([(k, "", v) for k, v in texts.items()], scenes.SCENE))
        found = changes.current_tokens(spark, sink)
        assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))

    put("one", "Hi\n*label a")
    put("two", "*set x 1")
    query = changes.keep_scanned(spark, str(scripts), sink)
    try:
        check(query, one="Hi\n*label a", two="*set x 1")
        put("one", "*label b\n*label c")
        put("three", "")
        check(query, one="*label b\n*label c", two="*set x 1", three="")
        before = spark.read.parquet(f"{sink}/versions").count()
        put("two", "*set x 1")  # written again, but the same
        check(query, one="*label b\n*label c", two="*set x 1", three="")
        assert spark.read.parquet(f"{sink}/versions").count() == before
        (scripts / "one.txt").unlink()
        check(query, two="*set x 1", three="")
    finally:
        query.stop()
    put("one", "*label again")  # while nothing runs
    put("two", "*set x 2")
    query = changes.keep_scanned(spark, str(scripts), sink)
    try:
        check(query, one="*label again", two="*set x 2", three="")
        replaced = spark.read.parquet(f"{sink}/versions").filter("scene_name = 'one'").orderBy("version").select("replaces", F.col("gone").cast("int").alias("gone")).collect()
        assert replaced[0].replaces is None and all(r.replaces for r in replaced[1:]) and [r.gone for r in replaced] == [0, 0, 1, 0]
    finally:
        query.stop()
