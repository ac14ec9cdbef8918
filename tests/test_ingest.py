"""Ingestion that is broken off and started again."""

import pytest

from tracewell.streaming.ingest import ingest, read_log

SCHEMA = "path string, length long, part string"


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp, budget=None, load=None):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/listing")
    started = ingest(stream, f"{tmp}/log", f"{tmp}/checkpoint", load, budget_bytes=budget).trigger(availableNow=True).start()
    try:
        started.awaitTermination()
    finally:
        started.stop()
    return read_log(stream, f"{tmp}/log")


def test_broken_off_between_load_and_log(spark, tmp_path):
    folder = f"{tmp_path}/listing"
    add(spark, folder, [("a", 5, "x"), ("b", 5, "x"), ("b", 5, "x"), (None, 5, "x")])
    run(spark, tmp_path, load=lambda taken, n: taken.write.mode("overwrite").parquet(f"{tmp_path}/data/batch_id={n}"))
    add(spark, folder, [("b", 5, "x"), ("c", 5, "y"), ("d", None, "y")])

    def fails(taken, n):
        taken.write.mode("overwrite").parquet(f"{tmp_path}/data/batch_id={n}")
        raise ValueError("lost")

    with pytest.raises(Exception, match="lost"):
        run(spark, tmp_path, load=fails)
    add(spark, folder, [("e", 1, "z"), ("a", 5, "z")])
    log = run(spark, tmp_path, load=lambda taken, n: taken.write.mode("overwrite").parquet(f"{tmp_path}/data/batch_id={n}"))
    want = [(0, "a"), (0, "b"), (1, "c"), (1, "d"), (2, "e")]
    assert sorted((r.batch_id, r.path) for r in log.collect()) == want
    assert sorted((r.batch_id, r.path) for r in spark.read.parquet(f"{tmp_path}/data").collect()) == want


def test_budget_leaves_files_waiting(spark, tmp_path):
    folder = f"{tmp_path}/listing"
    sizes = {"a": 4, "b": 4, "c": 4, "d": 50, "e": 1, "f": 1}
    for names in ("abc", "de", "f", ""):
        add(spark, folder, [(n, sizes[n], "x") for n in names] or [("a", 4, "x")])
        log = run(spark, tmp_path, budget=8)
    taken = sorted((r.batch_id, r.path) for r in log.where("taken").collect())
    assert taken == [(0, "a"), (0, "b"), (1, "c"), (1, "d"), (2, "e"), (2, "f")]
    assert sorted((r.batch_id, r.path) for r in log.where("not taken").collect()) == [(0, "c"), (1, "e")]
