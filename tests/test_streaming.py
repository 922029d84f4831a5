"""Streams over several micro-batches: state and versions carry across batches."""

import os

from pyspark.sql import functions as F

from lingua_spark.session import ensure_checkpoint_dir


def _two_file_dir(spark, rows1, rows2, schema, name):
    import uuid
    base = os.path.join(ensure_checkpoint_dir(spark), "test_in", f"{name}-{uuid.uuid4().hex}")
    spark.createDataFrame(rows1, schema).coalesce(1).write.parquet(base + "/part=1")
    spark.createDataFrame(rows2, schema).coalesce(1).write.parquet(base + "/part=2")
    return base


def test_failure_runs_state_across_batches(spark):
    from lingua_spark.streaming.streams import stream_failure_runs
    schema = "call_id long, provider string, ok boolean, t_us long"
    base = _two_file_dir(spark, [(1, "p", False, 1), (2, "p", False, 2)], [(3, "p", False, 3), (4, "p", True, 4)],
                         schema, "runs")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base + "/part=*")
    got = {r.call_id: (r.run_len, r.tripped) for r in stream_failure_runs(s, 3).collect()}
    assert got == {1: (1, False), 2: (2, False), 3: (3, True), 4: (0, False)}


def test_cache_upsert_versions_across_batches(spark):
    from lingua_spark.streaming.streams import stream_cache_upsert
    schema = "key_hash string, translation string, created_at timestamp"
    base = _two_file_dir(spark, [("a", "a1", None), ("b", "b1", None)], [("a", "a2", None)], schema, "upsert")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base + "/part=*")
    init = spark.createDataFrame([("c", "c0", None)], schema)
    out = stream_cache_upsert(s, init, lambda b: b.withColumn("created_at", F.current_timestamp()))
    assert {r.key_hash: r.translation for r in out.collect()} == {"a": "a2", "b": "b1", "c": "c0"}


def _arrive(spark, base, k, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{base}/part={k}")
    return spark.readStream.schema(schema).parquet(f"{base}/part=*")


def _folder(spark, name):
    import uuid
    return os.path.join(ensure_checkpoint_dir(spark), "test_in", f"{name}-{uuid.uuid4().hex}")


DEDUP = "key_hash string, call_id long, t_us long"
S = 1_000_000


def _fold(rows, ttl):
    """WN-3 by definition, over rows (key, id, t)."""
    last, out = {}, {}
    for key, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        write = key not in last or t > last[key] + ttl
        last[key] = t if write else last[key]
        out[i] = "write" if write else "hit"
    return out


def test_dedup_resumes_after_idle_runs_and_late_rows(spark):
    """Four starts on one folder, one without new rows, one with late ones: what is not late equals the batch fold."""
    from lingua_spark.streaming.streams import stream_dedup
    source, base = _folder(spark, "dedup"), _folder(spark, "dedup-base")
    first = [("a", 1, 1 * S), ("a", 2, 4 * S), ("b", 3, 2 * S), ("a", 4, 30 * S)]
    second = [("a", 5, 25 * S), ("b", 6, 3 * S), ("c", 7, 90 * S), ("a", 8, None)]  # 6 is late (delay 10 s), 5 is not, 8 has no time
    third = [("a", 9, 200 * S), ("b", 10, 150 * S), ("b", 11, 190 * S), ("c", 12, 1 * S)]  # 12 is late
    run = lambda: {r.call_id: r.action for r in stream_dedup(s, "key_hash", "t_us", "call_id", 10.0, 10.0, base=base, late=True).collect()}
    s = _arrive(spark, source, 1, first, DEDUP)
    assert run() == _fold(first, 10 * S)
    assert run() == _fold(first, 10 * S)  # nothing new
    s = _arrive(spark, source, 2, second, DEDUP)
    kept = first + [second[0], second[2]]
    assert run() == {**_fold(kept, 10 * S), 6: "late", 8: "late"}
    s = _arrive(spark, source, 3, third, DEDUP)
    kept += third[:3]
    assert run() == {**_fold(kept, 10 * S), 6: "late", 8: "late", 12: "late"}
    assert run() == {**_fold(kept, 10 * S), 6: "late", 8: "late", 12: "late"}
    on_time = stream_dedup(s, "key_hash", "t_us", "call_id", 10.0, 10.0, base=base)
    assert on_time.columns == ["key_hash", "call_id", "t_us", "action"] and on_time.count() == len(kept)


def test_failure_runs_resume_across_slices(spark):
    """Runs that go on over slices, starts, an idle start and a success; a late row is no part of any run."""
    from lingua_spark.streaming.streams import stream_failure_runs
    schema = "call_id long, provider string, ok boolean, t_us long"
    source, base = _folder(spark, "runs"), _folder(spark, "runs-base")
    first = [(i, "p", False, i * 4 * S) for i in range(1, 6)] + [(20, "q", True, 3 * S), (21, "q", False, 19 * S)]
    second = [(6, "p", False, 31 * S), (7, "p", True, 33 * S), (8, "p", False, 34 * S), (22, "q", False, 45 * S), (9, "p", False, 2 * S), (10, "p", False, 36 * S)]
    s = _arrive(spark, source, 1, first, schema)
    run = lambda: {r.call_id: (r.run_len, r.tripped) for r in stream_failure_runs(s, 3, 5.0, base=base, slice_seconds=10.0, late=True).collect()}
    want = {1: (1, False), 2: (2, False), 3: (3, True), 4: (4, False), 5: (5, False), 20: (0, False), 21: (1, False)}
    assert run() == want
    assert run() == want
    s = _arrive(spark, source, 2, second, schema)
    want |= {6: (6, False), 7: (0, False), 8: (1, False), 10: (2, False), 22: (2, False), 9: (None, None)}
    assert run() == want
    s = _arrive(spark, source, 3, [(11, "p", False, 100 * S), (23, "q", False, 101 * S)], schema)
    want |= {11: (3, True), 23: (3, True)}
    assert run() == want


def test_nothing_arrived(spark):
    from lingua_spark.streaming.streams import stream_dedup, stream_failure_runs
    s = _arrive(spark, _folder(spark, "none"), 1, [], DEDUP)
    assert stream_dedup(s, "key_hash", "t_us", "call_id", 10.0, 1.0).collect() == []
    s = _arrive(spark, _folder(spark, "none"), 1, [], "call_id long, provider string, ok boolean, t_us long")
    assert stream_failure_runs(s, 3).collect() == []


def test_dedup_shares_state_between_keys(spark, monkeypatch):
    """Many keys share a few calls of the processor, and answers are those of the fold; last writes that can make no hit any more leave
    the state."""
    import random
    from lingua_spark.streaming.ordered import rocksdb_state, state
    from lingua_spark.streaming.streams import stream_dedup
    monkeypatch.setattr("lingua_spark.streaming.streams.BUCKETS", 4, raising=False)
    rng = random.Random(3)
    source, base = _folder(spark, "shared"), _folder(spark, "shared-base")
    portions = [[(f"k{rng.randrange(700)}", 10_000 * k + i, rng.randrange(300 * k * S, 300 * (k + 1) * S)) for i in range(1500)] for k in range(2)]
    for k, rows in enumerate(portions):
        s = _arrive(spark, source, k, rows, DEDUP)
        got = {r.call_id: r.action for r in stream_dedup(s, "key_hash", "t_us", "call_id", 40.0, 50.0, base=base, late=True).collect()}
        assert got == _fold(sum(portions[:k + 1], []), 40 * S)
    with rocksdb_state(spark):
        last = state(spark, base, "last")
        assert 0 < last.count() <= 4
        assert last.selectExpr("explode(value.t_us) t").agg(F.min("t")).first()[0] + 40 * S > max(r[2] for r in portions[1]) // 1000 * 1000 - 50 * S
