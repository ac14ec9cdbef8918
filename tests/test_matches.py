"""The interval join of two streams against the batch form, over shuffled batches."""

import datetime
import random

from pyspark.sql import functions as F

from tracewell.operators.intervals import detections_hit
from tracewell.streaming.matches import stream_matches

START = datetime.datetime(2024, 1, 1)
AT = lambda s: START + datetime.timedelta(seconds=s)
DETECTIONS, EVENTS = "s string, id long, t_on timestamp, t_off timestamp", "s string, t timestamp"


def test_equals_batch(spark, tmp_path):
    r = random.Random(2)
    found = [(r.choice("ab"), i, AT(x := r.randrange(3000)), AT(x + r.randrange(90))) for i, _ in enumerate(range(60))]
    events = [(r.choice("ab"), AT(r.randrange(3000))) for _ in range(40)]
    for rows, schema, name in ((found, DETECTIONS, "found"), (events, EVENTS, "events")):
        r.shuffle(rows)
        for i in range(3):
            spark.createDataFrame(rows[i::3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    # rows far ahead of all others move both watermarks
    for schema, name, row in ((DETECTIONS, "found", ("z", -1, AT(90_000), AT(90_000))), (EVENTS, "events", ("y", AT(90_000)))):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    live = stream_matches(read("found", DETECTIONS), read("events", EVENTS), ["s"], 15, 120)
    run = live.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    want = [(d[1], e[1]) for d in found for e in events if d[0] == e[0] and d[2] - datetime.timedelta(seconds=15) <= e[1] <= max(d[2] + datetime.timedelta(seconds=15), d[3])]
    assert sorted((x.id, x.t) for x in got if x.t) == sorted(want) and want
    met = {i for i, _ in want}
    assert sorted(x.id for x in got if not x.t) == sorted(d[1] for d in found if d[1] not in met)
    seconds = lambda c: F.col(c).cast("double").alias(c)
    batch = detections_hit(spark.createDataFrame(found, DETECTIONS).select("s", "id", seconds("t_on"), seconds("t_off")), spark.createDataFrame(events, EVENTS).select("s", seconds("t")), ["s"])
    assert {x.id for x in batch.where("hit").collect()} == met
