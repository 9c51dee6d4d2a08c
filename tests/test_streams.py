"""Streams read from files in several triggers against the batch forms."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lodestone.streaming import streams

CHUNKS = "stream long, seq long, text string, done boolean"


def run(spark, tmp_path, schema, batches, transform):
    """What the transformation yields, a file of rows a trigger."""
    source = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
    source.mkdir()
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for i in range(len(batches)):
        for f in (tmp_path / f"b{i}").glob("*.parquet"):
            f.rename(source / f"{i}-{f.name}")
        stream = transform(spark.readStream.schema(schema).parquet(str(source)))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).collect()


def frame(payload):
    return f"data: {payload}\n\n"


def test_null_frames_across_micro_batches(spark, tmp_path):
    cases = [
        [frame('{"a":1}') + frame("null") + frame('{"b":2}')], [frame('{"a":1}') + "data: nu", "ll\n\n" + frame('{"b":2}')], [frame("null") + frame("x")], [frame('{"a":1}') + "data: null"],
        [frame('{"delta":"data: null"}')], ["data: null\n", "\n", "\n", "x"], [" data: null \r", "\n\r\n", "data: null\n\n\nend"], ["", None], ["no newline"],
    ]
    rng = random.Random(3)
    for _ in range(20):
        body = "".join(rng.choice([frame("null"), frame("x"), "\n", "data: null\n", " \n", "y"]) for _ in range(12))
        at = sorted(rng.sample(range(len(body) + 1), 4))
        cases.append([body[a:b] for a, b in zip([0, *at], [*at, len(body)], strict=True)])
    rows = [(i, q, t, q == len(c) - 1) for i, c in enumerate(cases) for q, t in enumerate(c)]
    batches = [[], [], []]
    for r in rows:  # chunks come in other batches than their order, and some twice
        batches[rng.randrange(3)] += [r] * rng.choice([1, 1, 2])
    got = {}
    for r in sorted(run(spark, tmp_path, CHUNKS, batches, streams.null_frames_removed), key=lambda r: (r.stream, r.seq)):
        got[r.stream] = got.get(r.stream, "") + r.text
    want = {r.stream: r.text for r in streams.without_null_frames(spark.createDataFrame(rows, CHUNKS).withColumn("text", F.coalesce("text", F.lit("")))).collect()}
    assert sum(map(len, batches)) > len(rows) + 10
    assert {i: t for i, t in want.items() if t} == {i: t for i, t in got.items() if t}


def test_rate_limit_on_a_stream(spark, tmp_path):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1, 12)
    rows = [(rng.randint(1, 4), start + dt.timedelta(seconds=rng.randint(0, 1200)), i) for i in range(300)]
    rows.sort(key=lambda r: (r[1], r[2]))
    late = [(1, start + dt.timedelta(seconds=5), 9000)]  # long after the watermark
    schema = "client long, ts timestamp, event_id long"
    batches = [rows[:120], rows[120:200], rows[200:], [(9, start + dt.timedelta(seconds=2000), 8000)], late]
    got = {(r.client, r.event_id): r.admitted for r in run(spark, tmp_path, schema, batches, lambda s: streams.rate_limited_stream(s, 5, 60, "1 minute")) if r.event_id < 8000}
    want = {(r.client, r.event_id): r.admitted for r in streams.rate_limited(spark.createDataFrame(rows, schema), 5, "1 minute").collect()}
    assert got == want and 50 < sum(want.values()) < 300
