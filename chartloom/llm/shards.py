"""Shards of near equal bytes by sampled splitters.

The key of a row is (hash of its text, doc_id, row number of the key table), so
equal texts lie together and a group larger than a shard is still cut.  Keys are
drawn with a chance in proportion to their bytes, quantiles of the draw become
range boundaries, and ranges that turn out overfull are cut again by a draw of
their own.  Running sums inside ranges, on top of the ranges' totals, then give
every row the exact number of bytes before it; that fixes its shard and slot.
Texts are read once and never shuffled: only keys move.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.llm.common import position_in, saved, table, whole

SHARDS = 24
#: keys drawn for each range; a range holds about 1/RANGES_A_SHARD of a shard at most
DRAWN, RANGES_A_SHARD = 20, 4
#: a group of equal texts up to this part of a shard is not cut
TOGETHER = 0.01
KEY = ("_k1", "_k2", "_k3")


def _unit(*seeds) -> Column:
    """A draw from [0, 1) that depends on the key and the seeds alone."""
    return F.shiftrightunsigned(F.xxhash64(*[F.col(k) for k in KEY], *[F.lit(s) for s in seeds]), 11) / F.lit(float(1 << 53))


def _range_of(splits: list[tuple], key: Column) -> Column:
    """Number of splitters at or below the key."""
    return position_in([F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip(KEY, row)]) for row in splits], key)


def _draw(keys: DataFrame, share: Column, round_: int) -> list[tuple]:
    rows = keys.where(_unit(round_) < share).select(*KEY).collect()
    return sorted((r[0], r[1], r[2]) for r in rows)


def shards(df: DataFrame, text: str = "text", id_: str = "doc_id", count: int = SHARDS) -> DataFrame:
    """The rows' id with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``.

    ``size`` is the text's bytes plus 8 (8 for null and empty).  Shards differ
    from an equal share by about one row's size or ``TOGETHER`` of a share; a row larger than a share
    leaves a neighbour short.  Repeated rows are placed one by one.  Only the id
    and the text are used, so other columns may have any name.  An empty table
    gives an empty result.  Rows keep their id even when it is null.
    """
    size = F.octet_length(whole(F.col(text))).cast("long") + 8
    keys = saved(
        df.select(
            F.col(id_).cast("long").alias("id"),
            size.alias("size"),
            F.crc32(whole(F.col(text)).cast("binary")).alias("text_crc32"),
            F.xxhash64(whole(F.col(text))).alias("_k1"),
        ).select(
            "*",
            F.coalesce(F.col("id"), F.lit(-(1 << 63))).alias("_k2"),
            F.monotonically_increasing_id().alias("_k3"),
        )
    )
    total = keys.agg(F.sum("size")).first()[0] or 0
    ranges = count * RANGES_A_SHARD
    limit = max(1.0, 2 * total / ranges)

    # the draw has about count * RANGES_A_SHARD * DRAWN keys, whatever the table's size
    drawn = _draw(keys, F.col("size") * F.lit(ranges * DRAWN / max(total, 1)), 0)
    splits = [drawn[i] for i in range(DRAWN, len(drawn), DRAWN)]
    placed = None
    for again in range(1, 6):
        placed = keys.withColumn("_range", _range_of(splits, F.struct(*KEY)))
        totals = {r["_range"]: (r["b"], r["n"]) for r in placed.groupBy("_range").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
        over = {k: b for k, (b, n) in totals.items() if b > limit and n > 1}
        if not over:
            break
        # cut each overfull range by a draw from its own keys
        share = F.col("size") * F.lit(DRAWN * 2.0 / limit)
        extra = placed.where(F.col("_range").isin(list(over))).where(_unit(again) < share).select("_range", *KEY).collect()
        found: dict[int, list[tuple]] = {}
        for r in extra:
            found.setdefault(r[0], []).append((r[1], r[2], r[3]))
        more = set(splits)
        for k, rows in found.items():
            rows.sort()
            every = max(1, len(rows) // math.ceil(2 * over[k] / limit))
            more.update(rows[every::every])
        if len(more) == len(splits):
            break
        splits = sorted(more)

    # one row a range: a bounded number, whatever the table's size
    bases, before, seen = [], 0, 0
    for k in sorted(totals):
        bases.append((k, before, seen))
        before, seen = before + totals[k][0], seen + totals[k][1]
    spark = df.sparkSession
    base = F.broadcast(spark.createDataFrame(bases, "_range int, _before long, _seen long"))
    order = Window.partitionBy("_range").orderBy(*KEY)
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = placed.join(base, "_range").select(
        "id", "size", "text_crc32", "_k1",
        (F.col("_before") + F.sum("size").over(run) - F.col("size")).alias("_at"),
        (F.col("_seen") + F.row_number().over(order) - 1).alias("_row"),
    )
    # equal texts stay together unless they are a notable part of a shard
    group = at.groupBy(F.col("_k1").alias("_g")).agg(
        F.min("_at").alias("_group_at"), F.sum("size").alias("_group_size"), F.count(F.lit(1)).alias("_n")
    ).where((F.col("_n") > 1) & (F.col("_group_size") <= F.lit(total / count * TOGETHER))).drop("_n")
    at = at.join(group, F.col("_k1") == F.col("_g"), "left").withColumns({
        "_at": F.coalesce("_group_at", "_at"), "_span": F.coalesce("_group_size", "size")
    }).select("id", "size", "text_crc32", "_at", "_span", "_row")
    middle = F.col("_at") * 2 + F.col("_span")
    shard = F.least(F.lit(count - 1), F.floor(middle.cast("decimal(38,0)") * count / F.lit(2 * max(total, 1)).cast("decimal(38,0)"))).cast("int")
    at = saved(at.withColumn("shard", shard))
    first = F.broadcast(at.groupBy(F.col("shard").alias("_shard")).agg(F.min("_row").alias("_first")))
    return at.join(first, F.col("shard") == F.col("_shard")).select(
        F.col("id").alias(id_), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_row") - F.col("_first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(df: DataFrame, path: str, text: str = "text", id_: str = "doc_id", count: int = SHARDS) -> None:
    """Write the table as one folder a shard (``shard=N``); ids must be unique and not null for this."""
    place = shards(df, text, id_, count).select(F.col(id_).alias("_id"), F.col("shard"), F.col("slot"))
    joined = df.drop("shard", "slot").join(place, F.col(id_) == F.col("_id")).drop("_id")
    joined.write.mode("errorifexists").partitionBy("shard").parquet(path)


RESULT = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def op5_shards(spark, folder: str) -> DataFrame:
    """Shard and slot of every document."""
    return shards(table(spark, folder, "documents").select("doc_id", "text")).select(*RESULT)
