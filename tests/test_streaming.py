import random
import time

from pyspark.sql import functions as F

from trackspark.streaming import stability, upsert

FRAMES = "video_id string, chunk_idx int, frame_idx int, max_iou double, num_objects int"


def rows(n=400):
    rng = random.Random(2)
    return [(v, c, f, rng.choice([0.01, 0.02, 0.05, 0.3]) if f % 90 > 60 else 0.01, rng.choice([1, 2, 3, 3])) for v in ("a", "b") for c in (0, 1) for f in range(n)]


def by_loop(data):
    hits, state = [], {}
    for v, c, f, m, n in sorted(data, key=lambda r: r[:3]):
        if n < 2:
            continue
        recent, since = state.get((v, c), ([], 50))
        recent, since = (recent + [m])[-10:], since + 1
        if len(recent) == 10 and sum(recent) / 10 < 0.08 and m < 0.08 and since >= 50:
            hits.append((v, c, f))
            recent, since = [], 0
        state[v, c] = (recent, since)
    return sorted(hits)


def test_trigger_batch_and_stream(spark, tmp_path):
    data = rows()
    want = by_loop(data)
    assert len(want) > 8
    batch = stability.stability_triggers(spark.createDataFrame(data, FRAMES))
    assert sorted((r["video_id"], r["chunk_idx"], r["frame_idx"]) for r in batch.collect()) == want
    src = str(tmp_path / "in")
    for lo in range(0, 400, 130):
        spark.createDataFrame([r for r in data if lo <= r[2] < lo + 130], FRAMES).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(src)
    q = stability.stability_stream(stream).writeStream.format("memory").queryName("hits").outputMode("append")
    q = q.option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["video_id"], r["chunk_idx"], r["frame_idx"]) for r in spark.sql("SELECT * FROM hits").collect())
    assert got == want


def test_state_goes_with_its_chunk(spark, tmp_path):
    """Chunk 0 ends by its last frame, chunk 1 by idling; chunk 2 goes on."""
    src, cp = str(tmp_path / "in"), str(tmp_path / "cp")

    def feed(data):
        spark.createDataFrame(data, FRAMES).coalesce(1).write.mode("append").parquet(src)

    def held():
        state = spark.read.format("statestore").option("stateVarName", "scan").load(cp)
        return sorted(r["c"] for r in state.select(F.col("key.chunk_idx").alias("c")).collect())

    def run(idle):
        stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(src)
        hits = stability.stability_stream(stream, ends=F.col("frame_idx") == 29, idle_seconds=idle)
        q = hits.writeStream.format("noop").option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()

    feed([("a", c, f, 0.01, 3) for c in (0, 1, 2) for f in range(20)])
    run(1.0)
    assert held() == [0, 1, 2]
    time.sleep(1.5)
    feed([("a", 0, f, 0.01, 1 if f == 29 else 3) for f in range(20, 30)] + [("a", 2, f, 0.01, 3) for f in range(20, 25)])
    run(600.0)
    assert held() == [2]


def test_runs_of_an_upsert(spark, tmp_path):
    assert upsert.merges(6) == [] and upsert.merges(7) == [(0, 7)] and upsert.merges(63) == [(56, 63), (0, 63)]
    assert upsert.cover([(0, 7), (0, 0), (3, 3), (8, 8), (9, 9)]) == [(0, 7), (8, 8), (9, 9)]
    schema = "video_id string, frame_idx int, object_id int, x int"
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    want = {}
    for b in range(30):
        rows = [("v", (b * k) % 17, 1, b) for k in range(3)]
        want.update({r[1]: r[3] for r in rows})
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)

    def run():
        q = upsert.start_upsert(stream, out, cp, order="x", fanout=3, files=2)
        q.processAllAvailable()
        q.stop()

    run()
    found = upsert.cover(upsert.runs(spark, out))
    assert found == [(0, 26), (27, 29)]
    assert sum(len(list(p.glob("*.parquet"))) for p in (tmp_path / "out").glob("run-*")) <= 2 * 6
    got = lambda: {r["frame_idx"]: r["x"] for r in upsert.current(spark, out).collect()}
    assert got() == want
    # The last batch failed after its merge: it is replayed and finds its runs.
    (tmp_path / "cp" / "commits" / "29").unlink()
    (tmp_path / "cp" / "commits" / ".29.crc").unlink(missing_ok=True)
    run()
    assert got() == want and upsert.cover(upsert.runs(spark, out)) == found
    # A run without its marker does not count.
    (tmp_path / "out" / "run-27-29" / "_SUCCESS").unlink()
    assert (27, 29) not in upsert.runs(spark, out)


def test_upsert_survives_restart(spark, tmp_path):
    schema = "video_id string, frame_idx int, object_id int, x string, seq int"
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = upsert.start_upsert(stream, out, cp, order="seq")
        q.processAllAvailable()
        q.stop()

    def add(*data):
        spark.createDataFrame(list(data), schema).coalesce(1).write.mode("append").parquet(src)

    add(("v", 1, 1, "a", 0), ("v", 1, 1, "b", 1), ("v", 2, 1, "a", 0))
    run()
    add(("v", 2, 1, "c", 0), ("v", 3, 1, "c", 0))
    run()
    run()  # nothing new: nothing changes
    got = {r["frame_idx"]: r["x"] for r in upsert.current(spark, out).collect()}
    assert got == {1: "b", 2: "c", 3: "c"}
