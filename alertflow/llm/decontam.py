"""Benchmark decontamination: test windows as a broadcast hash table, probed by every window of the training texts.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertflow.llm.common import ascii_lower, saved

#: Consecutive words in a window.
WINDOW = 10
#: Bytes of window texts that may be broadcast; a larger benchmark is joined by a shuffle on the window.
BROADCAST_BYTES = 64 << 20
#: What separates words: ASCII other than digits and letters.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-case words: runs of digits, a-z and everything beyond ASCII. Null has none."""
    return F.filter(F.split(ascii_lower(text), GAPS), lambda w: w != "")


def _windows(words_: Column, length: Column | int) -> Column:
    """Every run of ``length`` words as one text; no runs in a shorter array."""
    n = F.lit(length) if isinstance(length, int) else length
    last = F.size(words_) - n
    runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(0)) + 1), lambda i: F.array_join(F.slice(words_, i, n), " "))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """``window`` (text), ``length`` (words) and ``items`` (ids as strings) of each distinct window of the benchmark.

    An item of fewer words than a window, but not none, is one window.
    """
    w = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    w = w.where(F.size("w") > 0).withColumn("length", F.least(F.size("w"), F.lit(window)))
    w = w.select("item", "length", F.explode(_windows(F.col("w"), F.col("length"))).alias("window"))
    return w.groupBy("window", "length").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``doc_id``, ``pos``, ``length``, ``items`` of each place where a benchmark window occurs.

    The join compares whole window texts, so each hit of the hash table is verified. ``docs`` has ``row`` and ``w``.
    """
    size = windows.agg(F.sum(F.octet_length("window") + 64).alias("bytes"), F.collect_set("length").alias("lengths")).first()
    table = F.broadcast(windows) if (size.bytes or 0) <= BROADCAST_BYTES else windows
    found = None
    for length in sorted(size.lengths):  # at most WINDOW lengths
        rows = docs.select("row", F.posexplode(_windows(F.col("w"), length)).alias("pos", "window"))
        some = rows.join(table.where(F.col("length") == length), "window").select("row", "pos", "length", "items")
        found = some if found is None else found.union(some)
    if found is None:
        found = docs.select("row", F.lit(0).alias("pos"), F.lit(0).alias("length"), F.array().cast("array<string>").alias("items")).where(F.lit(False))
    return found


def _covered(spans: Column) -> Column:
    """Positions that lie in any of the (pos, length) spans of one text."""
    step = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["pos"] + s["length"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["pos"] + s["length"] - F.greatest(acc["end"], s["pos"]))).alias("n"),
        ),
    )
    return step["n"]


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted), ``spans`` (pos, length).

    A word is hit when it lies inside any occurrence of a benchmark window. Texts stay where they are read: only hits
    are shuffled, to be joined with the word counts. Rows that repeat an id are told apart by their text. Null ids and
    null, empty or very long texts, empty tables, repeated or null items are allowed: a null text has no words and no
    hits, a null item id has no name to report and counts for nothing but the words it hits. Other columns are ignored.
    """
    rows = docs.select(
        F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash")).alias("row"),
        words(F.col(text_col)).alias("w"),
    )
    windows = saved(benchmark_windows(benchmark, item_col, item_text_col, window), "windows")
    found = (
        hits(rows, windows)
        .groupBy("row")
        .agg(
            F.collect_set(F.struct("pos", "length")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
        .withColumn("n_hit", _covered(F.col("spans")).cast("long"))
    )
    counts = rows.select("row", F.coalesce(F.size("w"), F.lit(0)).cast("long").alias("n_words"))
    found = found.withColumn("id", F.col("row.id")).withColumn("hash", F.col("row.hash")).drop("row")
    counts = counts.select(F.col("row.id").alias("doc_id"), F.col("row.hash").alias("doc_hash"), "n_words")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("doc_hash") == F.col("hash"))
    none = F.array().cast("array<string>")
    return counts.join(found, same, "left").select(
        "doc_id",
        F.greatest("n_words", F.lit(0)).alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        "spans",
    )


def report(scanned: DataFrame) -> DataFrame:
    """The scan with a digest of the items in place of their names."""
    return scanned.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.greatest("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_ids(scanned: DataFrame) -> DataFrame:
    """Documents without a hit."""
    return scanned.where(F.col("n_hit") == 0).select("doc_id")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """Documents in which no benchmark window occurs, with all their columns.

    Rows are removed by their id and text, so of rows that repeat an id only those with a hit go.
    """
    names = docs.columns
    rows = docs.select(
        F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash")).alias("row"),
        words(F.col(text_col)).alias("w"),
    )
    windows = saved(benchmark_windows(benchmark, "item_id", "text", window), "windows")
    bad = hits(rows, windows).select(F.col("row.id").alias("bad_id"), F.col("row.hash").alias("bad_hash")).distinct()
    keep = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("d"))
    same = F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("bad_id")) & (F.xxhash64(F.col(f"d.`{text_col}`")) == F.col("bad_hash"))
    return keep.join(bad, same, "left_anti").select("d.*")
