"""Mix sources to target weights by cutting a hash-random order at each source's exact budget.

Every row gets a hash-random key. The key's range gives it one of a fixed number of
buckets inside its source; bucket totals give distributed prefix sums, and a window inside
(source, bucket) gives each row its place. A source takes whole epochs, then the first
words of its order up to its budget; ``taken`` counts words to the word, ``copies`` counts
whole documents (the one that the cut meets is in if at least half of it is).

Defined cases: a null text has size 0; null is a source of its own, last in order; a
source of size 0 has target 0; equal rows share the cut in any order; an empty table gives
an empty result; input columns called like an output are replaced.
Only the source table (one row a source, at most ``max_sources``) is ordered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from watchloom.llm.common import stored

WEIGHTS = (3, 1, 2)
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: float = 2.0, max_sources: int = 1_000_000) -> DataFrame:
    """(_none, _src, source_size) with ``target``: shares by weight, held at ``most`` times the size, the excess shared anew.

    Sources fill up in the order of cap / weight; the first one whose share of what is left
    stays below its cap sets the level for all after it.
    """
    every = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy("_none", "_src")))
    ranked = ranked.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1))
    ranked = ranked.withColumn(
        "_w", F.when(F.count(F.lit(1)).over(every) > max_sources, F.raise_error(F.lit("more sources than max_sources")).cast("double")).otherwise(F.col("_w"))
    )
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = (
        ranked.withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("_all", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("_left", F.col("_all") - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.sum("_w").over(later))
        .withColumn("_open", F.col("_level") * F.col("_w") < F.col("_cap"))
    )
    level = F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_w"), F.col("_rank"), F.col("_level")))).over(every)["_level"]
    return filled.withColumn("_at", level).select(
        "_none", "_src", "source_size", F.when(F.col("_at").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_at") * F.col("_w"))).alias("target")
    )


def _parts(df: DataFrame, names: Sequence[str], source: str, seed: int, buckets: int) -> DataFrame:
    """``df`` with its source (_none, _src), hash-random _key over ``names``, and bucket _b."""
    cols = [F.col(f"`{c}`") for c in names]
    return df.withColumns(
        {
            "_none": F.col(f"`{source}`").isNull(),
            "_src": F.coalesce(F.col(f"`{source}`"), F.lit("")),
            "_key": F.xxhash64(F.lit(seed), *[x for c in cols for x in (c.isNull(), c)]),
        }
    ).withColumn("_b", F.floor((F.col("_key").cast("double") / F.lit(2.0**64) + 0.5) * buckets).cast("int"))


def _bases(sums: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Buckets (words _in) with the words before them in their source and what the source takes: whole epochs _full, then its first _rest words."""
    targets = source_targets(sums.groupBy("_none", "_src").agg(F.sum("_in").alias("source_size")), weights, share, most)
    before = Window.partitionBy("_none", "_src").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return (
        sums.withColumn("_base", F.coalesce(F.sum("_in").over(before), F.lit(0)))
        .join(targets, ["_none", "_src"])
        .withColumn("_full", full)
        .withColumn("_rest", budget - F.col("_full") * F.col("source_size"))
    )


def _taken(folded: DataFrame, bases: DataFrame, names: Sequence[str], size: str) -> DataFrame:
    """Rows of ``folded`` (equal ones once, with their number _n) each with taken and copies, by their place in the bucket."""
    group, cols = ["_none", "_src", "_b"], [F.col(f"`{c}`") for c in names]
    inside = Window.partitionBy(*group).orderBy("_key", *cols).rowsBetween(Window.unboundedPreceding, -1)
    placed = folded.join(bases.drop("_in"), group).withColumn("_at", F.col("_base") + F.coalesce(F.sum(F.col(f"`{size}`") * F.col("_n")).over(inside), F.lit(0)))
    each = placed.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    words, full, rest = F.col(f"`{size}`"), F.col("_full"), F.col("_rest")
    start = F.col("_at") + F.col("_i") * words
    part = F.greatest(F.lit(0).cast("long"), F.least(words, rest - start))
    # a document without words goes with the whole epochs and with the cut's side that it lies on
    whole = F.when(words > 0, part * 2 >= words).otherwise(start < rest)
    return each.select(*cols, "source_size", "target", (full * words + part).alias("taken"), (full + whole.cast("long")).alias("copies"))


def mix(
    df: DataFrame,
    size: str = "size",
    source: str = "source",
    seed: int = 7,
    weights: Sequence[int] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``df`` (groupable columns) with source_size, target, taken and copies."""
    names = [c for c in df.columns if c not in ("source_size", "target", "taken", "copies")]
    folded = _parts(df.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.count(F.lit(1)).alias("_n")), names, source, seed, buckets)
    sums = folded.groupBy("_none", "_src", "_b").agg(F.sum(F.col(f"`{size}`") * F.col("_n")).alias("_in"))
    return _taken(folded, _bases(sums, weights, share, most), names, size)


def mix_table(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The narrow result for a documents table."""
    narrow = docs.select("doc_id", word_count(F.col("text")).alias("size"), "source", F.xxhash64("text").alias("_text"))
    return mix(narrow, seed=seed).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """Documents in the mix, each as often as whole copies of it are taken.

    Rows get size and key once and are stored. Buckets before and behind their source's cut are settled by one row a source,
    so that their texts are not shuffled; rows of the buckets at the cut are ordered as in ``mix``.
    """
    kept = [f"_c{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    text, source = (kept[docs.columns.index(c)] for c in ("text", "source"))
    names = [*kept, "_size"]
    rows = stored(_parts(docs.toDF(*kept).withColumn("_size", word_count(F.col(text))), names, source, seed, BUCKETS), "mix-sized")
    bases = _bases(rows.groupBy("_none", "_src", "_b").agg(F.sum("_size").alias("_in")), WEIGHTS, 1.5, 2.0)
    at_cut = bases.where((F.col("_base") <= F.col("_rest")) & (F.col("_rest") <= F.col("_base") + F.col("_in")))
    cuts = at_cut.groupBy("_none", "_src").agg(F.min("_b").alias("_first"), F.max("_b").alias("_last"), F.max("_full").alias("_whole"))
    dealt, at = rows.join(cuts, ["_none", "_src"]), F.col("_b").between(F.col("_first"), F.col("_last"))
    settled = dealt.where(~at).withColumn("copies", F.col("_whole") + (F.col("_b") < F.col("_first")).cast("long"))
    folded = dealt.where(at).groupBy("_none", "_src", "_b", "_key", *names).agg(F.count(F.lit(1)).alias("_n"))
    out = settled.select(*kept, "copies").unionAll(_taken(folded, at_cut, names, "_size").select(*kept, "copies")).where("copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*kept).toDF(*docs.columns)
