"""Ad-hoc lake questions, shop tables, login streaks and trace timelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions.columns import epoch, seconds_between


def daily_latency(events: DataFrame, day: Column) -> DataFrame:
    """Events and mean latency by source for one day."""
    start = F.date_trunc("day", day)
    return (
        events.where((F.col("ts") >= start) & (F.col("ts") < start + F.expr("interval 1 day")))
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("avg_latency"))
    )


def count_by_source(events: DataFrame) -> DataFrame:
    return events.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def shop_stats(orders: DataFrame, users: DataFrame, total: str = "total", order_id: str = "order_id", user_id: str = "user_id") -> DataFrame:
    """Orders, revenue and users as one row."""
    none = F.lit(None)
    o = orders.agg(F.count(order_id).alias("orders"), F.coalesce(F.sum(total), F.lit(0.0)).alias("revenue"), none.cast("bigint").alias("users"))
    u = users.agg(none.cast("bigint").alias("orders"), none.cast("double").alias("revenue"), F.count(user_id).alias("users"))
    return o.unionByName(u).agg(F.max("orders").alias("orders"), F.max("revenue").alias("revenue"), F.max("users").alias("users"))


def order_detail(orders: DataFrame, items: DataFrame, key: str = "order_id") -> DataFrame:
    """Each order beside each of its items, one row per item.

    An order with very many items stays spread over rows, which the skew join can split.
    """
    return orders.join(items, key)


def order_document(orders: DataFrame, items: DataFrame, order_id: int, key: str = "order_id", fields: Sequence[str] = ("product_id", "quantity", "unit_price")) -> DataFrame:
    """One order as a single nested row, the form an order page shows."""
    lines = items.where(F.col(key) == order_id).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("items"))
    return orders.where(F.col(key) == order_id).join(lines, key)


def order_totals(items: DataFrame, products: DataFrame) -> DataFrame:
    """Total price per order, kept only when every line is in stock.

    items: order_id, product_id, quantity; products: product_id, price, stock.
    """
    lines = items.join(products, "product_id", "left")
    missing = F.col("price").isNull() | (F.col("stock") < F.col("quantity"))
    per = lines.groupBy("order_id").agg(
        F.sum(F.col("price") * F.col("quantity")).alias("total"), F.count(F.lit(1)).alias("lines"), F.count_if(missing).alias("unavailable")
    )
    return per.where(F.col("unavailable") == 0).drop("unavailable")


def price_mismatches(items: DataFrame, products: DataFrame) -> DataFrame:
    """Order lines charged at another price than the product's."""
    return items.join(products, "product_id").where(F.col("unit_price") != F.col("price"))


def failed_login_streak(attempts: DataFrame, key: str = "user_id", ok: str = "success", order: Sequence[str] = ("ts", "event_id"), chunk_seconds: int = 60) -> DataFrame:
    """Consecutive failures up to and including each attempt; a success resets to 0.

    Attempts are counted inside short time chunks of a user, and what a chunk hands
    on (failures since its last success) is carried over chunk totals. A user with
    very many attempts is thereby spread over chunks instead of one sorted group.
    """
    ts = order[0]
    rows = attempts.withColumn("chunk", F.floor(epoch(ts) / chunk_seconds))
    here = Window.partitionBy(key, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = Window.partitionBy(key, "chunk", "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("run", F.sum(F.when(F.col(ok), 1).otherwise(0)).over(here)).withColumn(
        "fails", F.sum(F.when(F.col(ok), 0).otherwise(1)).over(run)
    )
    # failures after a chunk's last success = failures in its last run
    by_run = local.groupBy(key, "chunk").agg(F.max(F.struct("run", "fails")).alias("last"))
    chunks = by_run.select(key, "chunk", F.col("last.run").alias("resets"), F.col("last.fails").alias("tail"))
    upto = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    chunks = chunks.withColumn("reset_no", F.sum(F.when(F.col("resets") > 0, 1).otherwise(0)).over(upto))
    since = Window.partitionBy(key, "reset_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    chunks = chunks.withColumn("open", F.sum("tail").over(since))
    carry = F.coalesce(F.lag("open").over(Window.partitionBy(key).orderBy("chunk")), F.lit(0))
    chunks = chunks.select(key, "chunk", carry.alias("carry"))
    return local.join(chunks, [key, "chunk"]).select(
        *attempts.columns, (F.col("fails") + F.when(F.col("run") == 0, F.col("carry")).otherwise(0)).alias("failed_streak")
    )


def trace_timeline(spans: DataFrame, logs: DataFrame, by: str = "trace_id") -> DataFrame:
    """Per trace: span count, first, last and duration, with its log and error counts; a trace that only has logs has no times.

    Each side is folded to one row per trace before they meet, so a trace with very
    many rows is combined on the map side and no pairs are formed.
    """
    s = spans.groupBy(by).agg(F.count(F.lit(1)).alias("spans"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    lg = logs.groupBy(by).agg(F.count(F.lit(1)).alias("logs"), F.count_if(F.col("severity") == "ERROR").alias("errors"))
    out = s.join(lg, by, "full")
    zero = F.lit(0).cast("bigint")
    return out.select(
        by, F.coalesce("spans", zero).alias("spans"), "first_ts", "last_ts", seconds_between("first_ts", "last_ts").alias("duration_sec"),
        F.coalesce("logs", zero).alias("logs"), F.coalesce("errors", zero).alias("errors"),
    )


def logs_with_trace(logs: DataFrame, spans: DataFrame, by: str = "trace_id") -> DataFrame:
    """Every log row beside the start of its trace and its offset from it."""
    starts = spans.groupBy(by).agg(F.min("ts").alias("trace_start"))
    return logs.join(starts, by).withColumn("offset_sec", seconds_between("trace_start", "ts"))
