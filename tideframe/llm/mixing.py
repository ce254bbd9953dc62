"""Mixing sources to target weights, in DataFrame operations only.

Each document gets a hash-random key. Within its source, documents are dealt to ranges of that key (as many ranges as
the source's row count asks for, so a hot source is spread like any other), sorted inside a range, and given the prefix
sum of sizes: the range's offset, found from per-range totals in two levels, plus the running sum inside the range.
The mix then reads a source from its first key on, whole epochs first, and stops at the exact budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import durable

#: A word: a maximal run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words as long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def global_prefix(df: DataFrame, order: Sequence[Column], name: str, **sums: Column) -> DataFrame:
    """``df`` with a global rank (from 1) and, for each of ``sums``, the sum over all rows before this one.

    A distributed sort numbers the rows of each range; per-range totals, one row a range, give the offsets. The sorted
    rows are written once, so ranges stay what they were when totals are read.
    """
    cols = {k: v for k, v in sums.items()}
    placed = durable(df.withColumns({f"_v_{k}": v for k, v in cols.items()}).orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in cols])
    offsets = totals.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in cols])
    out = placed.join(offsets, "_range").withColumn("rank", F.col("_n0") + F.coalesce(F.count(F.lit(1)).over(inside), F.lit(0)) + 1)
    out = out.withColumns({f"{k}_before": F.col(f"_o_{k}") + F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) for k in cols})
    return out.drop("_range", "_at", "_n0", *[f"_v_{k}" for k in cols], *[f"_o_{k}" for k in cols])


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Targets of ``sizes`` (source, source_size, n_docs): weight by weight, none above ``most`` times its source.

    Sources in order of the ratio cap / weight are capped one by one until the level that the rest then share by weight
    lies at or below the next one's ratio; that level is the exact solution, not an iteration towards it.
    """
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    wanted = float(share) * total
    ranked = global_prefix(sizes, [F.col("source").asc_nulls_last()], "mix-sources").withColumnRenamed("rank", "source_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    all_weight = ranked.agg(F.sum("weight")).first()[0] or 0.0
    ranked = global_prefix(ranked, [F.col("cap") / F.col("weight"), F.col("source_rank")], "mix-levels", cap=F.col("cap"), weight=F.col("weight"))
    level = (F.lit(wanted) - F.col("cap_before")) / (F.lit(all_weight) - F.col("weight_before"))
    first = ranked.where(level <= F.col("cap") / F.col("weight")).agg(F.min(F.struct("rank", level.alias("level"))).alias("m")).first()["m"]
    if first is None:
        return ranked.select("source", "source_rank", "source_size", "n_docs", F.col("cap").alias("target"))
    return ranked.select("source", "source_rank", "source_size", "n_docs", F.when(F.col("rank") >= first["rank"], F.lit(first["level"]) * F.col("weight")).otherwise(F.col("cap")).alias("target"))


def mix_sources(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    cut: str = "words",
    seed: str = "mix",
    rows_per_range: int = 4096,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, copies, and the columns named in ``keep``.

    docs: doc_id, source, text; other columns are ignored. ``weights`` are given to the sources in code point order,
    null last, and repeat. ``share`` times all sizes is dealt out. With ``cut="words"`` the document at the budget gives
    only the words that are left, so a source's taken words are the floor of its target. With ``cut="documents"`` only
    whole documents are taken, the one at the budget if at least half of it fits; ``copies`` says how often.

    Null source: a source of its own, last. Null or wordless text: size 0, nothing taken; with ``cut="documents"`` such a
    document is taken once, as it costs nothing. Null doc_id: the key comes from the text. Rows equal in doc_id are ordered
    by size and then by ``keep``; full duplicates are interchangeable. Empty table: no rows. Reruns agree.
    """
    if cut not in ("words", "documents"):
        raise ValueError(f"cut is words or documents, not {cut!r}")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.coalesce(F.md5("text"), F.lit(""))))))
    kept = [f"_keep_{c}" for c in keep]
    sized = durable(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("_key"), *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)]), "mix-sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = durable(source_targets(sizes, weights, share, most), "mix-targets").withColumnRenamed("source", "_source")

    bits = F.greatest(F.lit(0), F.least(F.lit(32), F.ceil(F.log2(F.col("n_docs") / F.lit(float(rows_per_range)))).cast("int")))
    key32 = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_bits", bits).withColumn("_range", F.floor(key32 / F.pow(F.lit(2.0), 32 - F.col("_bits"))).cast("long"))
    rows = rows.withColumn("_super", F.floor(F.col("_range") / F.pow(F.lit(2.0), F.ceil(F.col("_bits") / 2))).cast("long"))

    ranges = rows.groupBy("source_rank", "_super", "_range").agg(F.sum("size").alias("_s"))
    supers = ranges.groupBy("source_rank", "_super").agg(F.sum("_s").alias("_s"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    supers = supers.select("source_rank", "_super", F.coalesce(F.sum("_s").over(before("source_rank").orderBy("_super")), F.lit(0)).alias("_o1"))
    ranges = ranges.select("source_rank", "_super", "_range", F.coalesce(F.sum("_s").over(before("source_rank", "_super").orderBy("_range")), F.lit(0)).alias("_o2"))
    offsets = ranges.join(supers, ["source_rank", "_super"]).select("source_rank", "_range", (F.col("_o1") + F.col("_o2")).alias("_offset"))

    inside = before("source_rank", "_range").orderBy("_key", F.col("doc_id").asc_nulls_last(), "size", *kept)
    rows = rows.join(offsets, ["source_rank", "_range"])
    rows = rows.withColumn("_before", F.col("_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))

    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    left = budget - epochs * F.col("source_size") - F.col("_before")
    if cut == "words":
        taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
        copies = F.when(F.col("size") > 0, F.ceil(taken / F.col("size"))).otherwise(F.lit(0))
    else:
        copies = F.when(F.col("size") > 0, epochs + (2 * left >= F.col("size")).cast("long")).otherwise(F.lit(1))
        taken = copies * F.col("size")
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), copies.cast("int").alias("copies"), *[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)])
