"""Equi joins of a table with very frequent keys against one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are looked for, and the share of the rows from which one counts as frequent.
HOT_KEYS, HOT_SHARE = 64, 0.005


def hot_keys(df: DataFrame, key: str) -> list:
    """The keys that hold at least HOT_SHARE of the rows, HOT_KEYS at most: from a sketch of fixed size per task."""
    got = df.agg(F.expr(f"approx_top_k(`{key}`, {HOT_KEYS})").alias("top"), F.count(key).alias("n")).first()
    return [x["item"] for x in got["top"] or [] if x["item"] is not None and x["count"] >= max(2, HOT_SHARE * got["n"])]


def join_per_key(rows: DataFrame, answers: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """`rows` joined with `answers`, which has one row per key (or a few). Rows with a `hot` key meet at most a few rows per
    hot key by broadcast and stay where they are; the rest is left to an ordinary join."""
    if not hot:
        return rows.join(answers, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(answers.filter(is_hot))
    return rows.filter(is_hot).join(few, key, how).unionByName(rows.filter(~is_hot).join(answers.filter(~is_hot), key, how))
