"""Keyed answer store: WN-1 latest, SRC-5 upsert, JN-3 lookup, JN-4 tiers, JN-8 dedup,
WN-2 capacity, WN-3 ttl dedup, SRC-6 JSON serialisation."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lingua_spark import constants as K


def latest_by_key(df: DataFrame, key: str | list, newest_first: list[str]) -> DataFrame:
    """WN-1: the newest row per key; `newest_first` names the recency columns compared in
    order, larger = newer, nulls oldest.

    A grouped max_by over the row struct, so map-side partial aggregation collapses a hot
    key before the shuffle (no window partition per key)."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*newest_first)).alias("_latest"))
    return agg.select(*keys, *[F.col("_latest")[c].alias(c) for c in rest])


def with_expiry(rows: DataFrame, created_at: Column, ttl_seconds) -> DataFrame:
    """created_at / expires_at for new cache rows; ttl <= 0 means one hour (memory tier rule)."""
    ttl = F.lit(ttl_seconds) if not isinstance(ttl_seconds, Column) else ttl_seconds
    ttl = F.when(ttl <= 0, F.lit(float(K.BACKFILL_TTL_SECONDS))).otherwise(ttl)
    return (rows.withColumn("created_at", created_at)
            .withColumn("expires_at", created_at + F.make_dt_interval(secs=ttl.cast("decimal(18,6)"))))


def _table(path: str) -> str:
    return f"lingua_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def write_bucketed(rows: DataFrame, path: str, buckets: int, key: str = "key_hash") -> DataFrame:
    """`rows` stored at `path` as Parquet, bucketed and sorted by `key`. Lookups and groupings by the key read such a
    table without shuffling it, whatever its size; only the other side moves."""
    (rows.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(_table(path)))
    return rows.sparkSession.table(_table(path))


def open_bucketed(spark: SparkSession, path: str, schema: StructType, buckets: int, key: str = "key_hash") -> DataFrame:
    """A table of `write_bucketed`, also in a session that did not write it."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_table(path)} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) "
              f"INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(_table(path))


def drop_bucketed(spark: SparkSession, path: str) -> None:
    from lingua_spark.session import delete_path
    spark.sql(f"DROP TABLE IF EXISTS {_table(path)}")
    delete_path(spark, path)


def cache_upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """SRC-5: insert-or-replace by key_hash; a row of `new` replaces any stored row of its key.

    Written as union + latest-wins so it runs as one shuffle on key_hash; ties inside `new`
    go to the later created_at.
    """
    cols = cache.columns
    nparts = int(cache.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # clustered explicitly: a keyed operator over a union must not trust the children's
    # partitioning (spark.sql.unionOutputPartitioning with independently coalesced shuffles)
    both = (cache.select(*cols).withColumn("_src", F.lit(0))
            .unionByName(new.select(*cols).withColumn("_src", F.lit(1)))
            .repartition(nparts, "key_hash"))
    return latest_by_key(both, "key_hash", ["_src", "created_at"]).drop("_src")


def fresh(cache: DataFrame, as_of) -> DataFrame:
    """Rows not yet expired at `as_of` (expired only when as_of is strictly after expires_at)."""
    t = F.lit(as_of) if not isinstance(as_of, Column) else as_of
    return cache.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= t))


def live_responses(requests: DataFrame, cache: DataFrame | list[DataFrame], as_of, unique: bool = False) -> DataFrame:
    """`requests` with the `cached_response` of their key_hash, null without a fresh one.

    `cache`: one table, of which the newest fresh row of a key counts (`unique` declares that no key has two), or the
    runs of a cache log, newest first and each unique: there the newest run that holds the key decides,
    whether its row is fresh or not. Every table is joined on key_hash alone, so bucketed ones are not shuffled."""
    if isinstance(cache, list):
        names = [f"_run{i}" for i in range(len(cache))]
        for name, run in zip(names, cache, strict=True):
            requests = requests.join(run.select("key_hash", F.struct("response", "expires_at").alias(name)), "key_hash", "left")
        t = F.lit(as_of) if not isinstance(as_of, Column) else as_of
        row = F.coalesce(*names)
        alive = row["expires_at"].isNull() | (row["expires_at"] >= t)
        return requests.withColumn("cached_response", F.when(alive, row["response"])).drop(*names)
    live = fresh(cache, as_of) if unique else latest_by_key(fresh(cache, as_of), "key_hash", ["created_at"])
    return requests.join(live.select("key_hash", F.col("response").alias("cached_response")), "key_hash", "left")


def cache_lookup(requests: DataFrame, cache: DataFrame, as_of, materialize: bool = True, unique: bool = False) -> tuple[DataFrame, DataFrame]:
    """JN-3: (hits, misses) of `requests` against the fresh rows of `cache` by key_hash.

    One left equi join on key_hash; hits and misses are its two halves. With materialize
    the joined table is written once to the shared checkpoint folder, so using both
    outputs does not evaluate the requests and the cache twice. A cache of write_bucketed is not shuffled.
    """
    looked = live_responses(requests, cache, as_of, unique)
    if materialize:
        from lingua_spark.session import cut_lineage
        looked = cut_lineage(looked)
    hits = looked.filter(F.col("cached_response").isNotNull())
    misses = looked.filter(F.col("cached_response").isNull()).drop("cached_response")
    return hits, misses


def tiered_lookup(requests: DataFrame, tiers: DataFrame, as_of,
                  backfill_ttl_seconds: float = K.BACKFILL_TTL_SECONDS,
                  materialize: bool = True) -> tuple[DataFrame, DataFrame]:
    """JN-4: first (lowest-numbered) tier holding a fresh row of the key wins, there the newest row.

    Returns (hits, backfill): backfill holds one row per faster tier (1 .. tier-1) to write,
    with the backfill ttl counted from `as_of`. Both come from one join of the requests
    with the per-key best tier (written once when materialize is set).
    """
    t = F.lit(as_of) if not isinstance(as_of, Column) else as_of
    nparts = int(tiers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # tiers is usually a union of tier tables: cluster it explicitly on the key
    live = fresh(tiers, as_of).repartition(nparts, "key_hash")
    best = (live.groupBy("key_hash")
            .agg(F.max_by(F.struct("tier", "response", "created_at"), F.struct(-F.col("tier"), "created_at")).alias("_b"))
            .select("key_hash", F.col("_b.tier").alias("hit_tier"), F.col("_b.response").alias("cached_response"),
                    F.col("_b.created_at").alias("hit_created_at")))
    hits = requests.join(best, "key_hash")
    if materialize:
        from lingua_spark.session import cut_lineage
        hits = cut_lineage(hits)
    keys = hits.select("key_hash", "hit_tier", "cached_response", "hit_created_at").dropDuplicates(["key_hash"])
    backfill = (keys.filter(F.col("hit_tier") > 1)
                .withColumn("tier", F.explode(F.sequence(F.lit(1), F.col("hit_tier") - 1)))
                .select("key_hash", F.col("cached_response").alias("response"),
                        F.col("hit_created_at").alias("created_at"),
                        (t + F.make_dt_interval(secs=F.lit(backfill_ttl_seconds))).alias("expires_at"), "tier"))
    return hits, backfill


def dedup_first(requests: DataFrame, key: str = "key_hash", order: list[str] | None = None,
                id_col: str = "request_id", materialize: bool = True) -> DataFrame:
    """JN-8 helper: mark the first request of each key (`is_first`, by `order` ascending,
    nulls first; default ts then request_id); later duplicates are answered from the first
    one's result and flagged cached.

    With materialize the requests are written once; the first id per key is then a grouped min_by that
    reads key, order and id only (partial aggregation collapses a hot key map-side), and joins back on the
    key, where AQE's skew-join handling can split a hot key."""
    if materialize:
        from lingua_spark.session import written_once
        requests = written_once(requests)
    order = order or ["ts", id_col]
    firsts = requests.groupBy(key).agg(F.min_by(F.col(id_col), F.struct(*order)).alias("_first_id"))
    return (requests.join(firsts, key).withColumn("is_first", F.col(id_col) == F.col("_first_id"))
            .drop("_first_id"))


def cap_entries(cache: DataFrame, max_entries: int, as_of) -> DataFrame:
    """WN-2: drop expired rows, keep the newest `max_entries` (created_at desc, key_hash).

    The last row to stay is found on the two order columns alone: they are range-sorted, the range buckets' counts tell
    in which bucket it lies, and that bucket names it. All rows are then compared with it where they are, so
    nothing else moves and no task holds `max_entries` rows. A key has one row in a cache; of several equal
    ones at the very end as many stay as there is room for."""
    from lingua_spark.operators.ids import range_sorted
    live = fresh(cache, as_of)
    if max_entries <= 0:
        return live.limit(0)
    order = [F.col("created_at").desc_nulls_last(), F.col("key_hash")]
    narrow = range_sorted(live.select("created_at", "key_hash"), order, "_b")
    counts = sorted((r["_b"], r["count"]) for r in narrow.groupBy("_b").count().collect())  # a row per range bucket
    before = 0
    for bucket, n in counts:
        if before + n >= max_entries:
            break
        before += n
    else:
        return live
    ranked = narrow.filter(F.col("_b") == bucket).withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(*order)))
    t, k = ranked.filter(F.col("_r") == max_entries - before).select("created_at", "key_hash").first()
    at, key = F.lit(t).cast(cache.schema["created_at"].dataType), F.col("key_hash")
    if t is None:
        earlier = F.col("created_at").isNotNull() | (key < F.lit(k))
    else:
        earlier = (F.col("created_at") > at) | ((F.col("created_at") == at) & (key < F.lit(k)))
    earlier = F.coalesce(earlier, F.lit(False))
    border = F.col("created_at").eqNullSafe(at) & key.eqNullSafe(F.lit(k))
    equal = ranked.filter(border).agg(F.count("*").alias("n"), F.sum(F.when(F.col("_r") <= max_entries - before, 1)).alias("room")).first()
    if equal["n"] == equal["room"]:
        return live.filter(earlier | border)
    return live.filter(earlier).unionByName(live.filter(border).limit(equal["room"]))


def ttl_dedup(requests: DataFrame, ttl_seconds: float, key: str = "key_hash", ts_micros: str = "ts_us",
              id_col: str = "request_id") -> DataFrame:
    """WN-3: per key, a request is a 'write' when no write happened in the previous ttl,
    else a 'hit'. The ttl is anchored at the write (hits do not refresh it); a write at t
    serves requests up to and including t + ttl. Request ids must be unique per key.

    The writes of a key are the path first request -> next -> next ..., next(e) being the first
    request strictly after t_e + ttl, and every request more than ttl after the one before it
    (a reset) is on the path. Requests and their probes at t + ttl are range-sorted together by
    (key, time) once; resets and next requests come from running frames per (key, range bucket)
    and carries between buckets, so no key is one window partition. The paths from all resets are
    then marked by pointer doubling: P holds the path positions [0, 2^r), J the 2^r-step jumps;
    each round adds J(P) and squares J, so the longest run of L writes without a reset needs
    log2(L) rounds of joins, each written to the shared checkpoint folder.
    """
    from lingua_spark.operators.ids import range_sorted
    from lingua_spark.session import cut_lineage
    ttl_us = int(round(ttl_seconds * 1_000_000))
    rows = requests.select(F.col(key), F.col(id_col).cast("long").alias(id_col), F.col(ts_micros).cast("long").alias(ts_micros))
    ev = rows.select(key, F.col(ts_micros).alias("_t"), F.lit(0).alias("_kind"), F.col(id_col).alias("_id"))
    probes = rows.select(key, (F.col(ts_micros) + ttl_us).alias("_t"), F.lit(1).alias("_kind"), F.col(id_col).alias("_id"))
    order = ["_t", "_kind", "_id"]  # a probe comes after the requests of its time
    both = range_sorted(ev.unionByName(probes), [key, *order], "_b")
    t_ev, id_ev = F.when(F.col("_kind") == 0, F.col("_t")), F.when(F.col("_kind") == 0, F.col("_id"))
    before = Window.partitionBy(key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(key, "_b").orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = both.groupBy(key, "_b").agg(F.max(t_ev).alias("_last"), F.min_by(id_ev, F.when(F.col("_kind") == 0, F.struct(*order))).alias("_first"))
    buckets = Window.partitionBy(key).orderBy("_b")
    carry = per_bucket.select(key, "_b", F.max("_last").over(buckets.rowsBetween(Window.unboundedPreceding, -1)).alias("_prev0"),
                              F.first("_first", ignorenulls=True).over(buckets.rowsBetween(1, Window.unboundedFollowing)).alias("_next0"))
    scanned = cut_lineage(
        both.withColumn("_prev", F.max(t_ev).over(before)).withColumn("_next", F.last(id_ev, ignorenulls=True).over(after))
        .join(carry, [key, "_b"]).select(key, "_t", "_kind", F.col("_id").alias(id_col), F.coalesce("_prev", "_prev0").alias("_prev"),
                                         F.coalesce("_next", "_next0").alias("_to")))
    path = scanned.filter("_kind = 0").filter(F.col("_prev").isNull() | (F.col("_t") - F.col("_prev") > ttl_us)).select(key, id_col)
    jump = scanned.filter("_kind = 1 and _to is not null").select(key, id_col, "_to")
    while True:
        new = cut_lineage(path.join(jump, [key, id_col]).select(key, F.col("_to").alias(id_col)).join(path, [key, id_col], "left_anti").distinct())
        if new.isEmpty():
            break
        path = cut_lineage(path.unionByName(new))
        far = jump.select(key, F.col(id_col).alias("_to"), F.col("_to").alias("_far"))
        jump = cut_lineage(jump.join(far, [key, "_to"]).select(key, id_col, F.col("_far").alias("_to")))
    return (rows.join(path.withColumn("_w", F.lit(True)), [key, id_col], "left")
            .select(key, id_col, ts_micros, F.when(F.col("_w"), F.lit("write")).otherwise(F.lit("hit")).alias("action")))


def response_to_json(response: Column) -> Column:
    """SRC-6: JSON text of a response struct with the reference's field names."""
    return F.to_json(response)


def write_responses(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """SRC-6 sink: one JSON object per response (or parquet with the struct kept)."""
    w = df.write.mode(mode)
    (w.json(path) if fmt == "json" else w.format(fmt).save(path))
