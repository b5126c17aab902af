"""Mixing of sources to target weights: repetition rates per source, whole copies plus one hash-seeded copy.

DataFrame functions only. Texts are read once for their sizes; after that only (id, source, size, draw) travels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertflow.llm.common import cut, ranked, saved

#: Weights by rank of the source, repeating; share of all sizes; most copies of a source on average.
WEIGHTS, SHARE, MOST = (5, 2, 1), (3, 2), 2
#: Draws are whole numbers below SPAN. Seed j adds j * STEP (odd, near the golden section) to them.
SPAN, STEP, SEEDS = 1 << 52, 2_783_377_641_436_327, 64
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column) -> Column:
    """A whole number below SPAN from the id and the text, so that a rerun draws the same and equal ids differ by text."""
    name = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long")


def measured(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``source``, ``size`` and ``draw`` of every row."""
    text, doc = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    return docs.select(
        doc.alias("doc_id"), F.col(source_col).cast("string").alias("source"), size_of(text).alias("size"), draw(doc, text).alias("draw")
    )


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """``source``, ``source_size`` and ``target`` of ``sizes`` (``source``, ``source_size``), a written table.

    Sources by code point, null last, have ``weights`` in turn and share (numerator, denominator) of all sizes by them.
    No target goes beyond ``most`` times its source; what is over goes to the others by weight, again and again until
    none is above. Every round settles at least one source more, in general far more; only two sums reach the driver.
    """
    up, down = share
    rank = ranked(sizes, [F.col("source").isNull(), F.col("source")], "rank")
    weight = F.get(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights)).cast("int"))
    table = cut(rank.select("source", "source_size", weight.cast("long").alias("weight"), F.lit(False).alias("full")))
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    total = int(table.agg(exact(F.col("source_size"))).first()[0] or 0)
    level = F.lit(0.0)
    while True:
        open_, full = F.when(~F.col("full"), F.col("weight")), F.when(F.col("full"), F.col("source_size"))
        w, held = (int(x or 0) for x in table.agg(exact(open_), exact(full)).first())
        if not w:
            break
        # whole numbers up to the one division, so that any order of adding gives the same level
        level = F.lit((up * total - down * most * held) / (down * w))
        above = ~F.col("full") & (level * F.col("weight") > most * F.col("source_size"))
        if table.where(above).isEmpty():
            break
        table = cut(table.withColumn("full", F.col("full") | above))
    target = F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(level * F.col("weight"))
    return table.select("source", "source_size", target.alias("target"))


def plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
         weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """One row per document: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``, ``draw``.

    The rate of a source is its target over its size. Each document is taken floor(rate) times, and once more if its draw
    falls below the fraction of the rate. Draws come from a hash of id and text, moved by one of 64 seeds; each source
    uses the seed whose taken words come nearest to its target (of equal ones the first), found with one aggregate, so
    a few long documents do not carry a source far from it. Rows that repeat an id and its text share one draw. Null
    sources are one source, the last; a null or empty text has size 0 and is still taken by its source's rate; a source
    without words has rate 0. Null ids are mixed like others. Other columns are ignored. An empty table gives an
    empty result.
    """
    rows = saved(measured(docs, id_col, source_col, text_col), "sizes")
    sizes = saved(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = targets(sizes, weights, share, most).withColumn("rate", rate)
    rates = rates.withColumn("whole", F.floor("rate").cast("long"))
    rates = saved(rates.withColumn("limit", F.floor((F.col("rate") - F.col("whole")) * SPAN).cast("long")), "rates")

    moved = lambda j: (F.col("draw") + F.lit(j * STEP % SPAN)) % SPAN
    both = _by_source(rows.select("source", "size", "draw"), rates.select("source", "limit"))
    more = [F.sum(F.when(moved(j) < F.col("limit"), F.col("size")).otherwise(0)).alias(f"s{j}") for j in range(SEEDS)]
    tried = _by_source(both.groupBy("source").agg(*more), rates)
    off = lambda j: F.abs(F.col("whole") * F.col("source_size") + F.col(f"s{j}") - F.col("target"))
    best = F.array_min(F.array(*(F.struct(off(j).alias("off"), F.lit(j).alias("seed")) for j in range(SEEDS))))["seed"]
    shift = (best.cast("long") * STEP) % SPAN
    chosen = tried.select("source", "source_size", "target", "whole", "limit", shift.alias("shift"))
    drawn = (F.col("draw") + F.col("shift")) % SPAN < F.col("limit")
    out = _by_source(rows, saved(chosen, "source-seeds")).withColumn("copies", F.col("whole") + drawn.cast("long"))
    return out.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "draw"
    )


def _by_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with their source's row. The planner broadcasts the table while it is small and splits a hot source else."""
    named = table.withColumnRenamed("source", "of")
    return rows.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **weights) -> DataFrame:
    """The mix itself: ``docs`` with all columns, each row as often as it is taken. Rows keep their order in no way."""
    found = plan(docs, id_col, source_col, text_col, **weights).where(F.col("copies") > 0)
    found = found.select(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("draw").alias("d"), "copies").distinct()
    text, doc = F.col(f"r.`{text_col}`").cast("string"), F.col(f"r.`{id_col}`").cast("long")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("r"))
    same = doc.eqNullSafe(F.col("i")) & F.col(f"r.`{source_col}`").cast("string").eqNullSafe(F.col("s")) & (draw(doc, text) == F.col("d"))
    rows = rows.join(found, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*(F.col(f"r.`{c}`").alias(c) for c in docs.columns))
