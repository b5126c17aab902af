"""Fuzzy line deduplication by MinHash over character shingles.

DataFrame functions only: shingles are rows, minima are aggregates, comparisons are join conditions.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertflow.llm.common import components, saved
from alertflow.llm.near import Scheme, pick

#: Characters of a shingle. One starts at every character, so each character of a line counts, with or without spaces.
SHINGLE = 5
#: 32 bins of one permutation (a power of two); a band has the minima of four of them, and any two bands share one bin at
#: most. Four bits of each minimum are kept for the estimate.
SCHEME = Scheme(percent=80, rows=4, bands=8, minima=32, bits=4, slack=3.0)
#: Other bins whose minimum an empty bin borrows, in turn, in each of two rounds, before it takes the least of all.
BORROW = 2
#: 64-bit words of a set's bitmap, in which each shingle sets the bit that its hash names.
MAP_WORDS = 32


def band(number: int, scheme: Scheme = SCHEME) -> list[int]:
    """The bins of a band: runs of neighbours first, then bins a stride apart."""
    stride = scheme.k // scheme.rows
    if number < stride:
        return list(range(number * scheme.rows, (number + 1) * scheme.rows))
    return [number - stride + stride * r for r in range(scheme.rows)]


def characters(line: Column) -> Column:
    """The line with four bytes a character, in which any shingle is found at once, however long the line is."""
    return F.encode(line, "UTF-32")


def starts(line: Column, n: int = SHINGLE) -> Column:
    """First byte of each shingle among the ``characters``: all runs of ``n``, of a shorter line the whole."""
    return F.sequence(F.lit(1), F.greatest(F.length(line) - n, F.lit(0)) * 4 + 1, F.lit(4))


def shingle_at(characters: Column, start: Column, n: int = SHINGLE) -> Column:
    return F.substring(characters, start, F.lit(4 * n))


def shingles_of(line: Column) -> Column:
    """Hashes of the shingles of a line, repeats included. The characters are bound to a name, so they are made once a line."""
    each = lambda chars: F.transform(starts(line), lambda at: F.xxhash64(shingle_at(chars, at)))
    return F.get(F.transform(F.array(characters(line)), each), F.lit(0))


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row`` (id and text hash) and ``text``."""
    row = F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"))
    return docs.select(row.alias("row"), F.col(text_col).alias("text"))


def exploded(texts: DataFrame) -> DataFrame:
    """``row``, ``line_no`` and lower-case ``line`` of every line that is not blank."""
    rows = texts.select("row", F.posexplode(F.split(F.lower("text"), "\n")).alias("line_no", "line"))
    # most lines begin with a visible sign and need no search
    return rows.where((F.ascii("line") > 32) | F.col("line").rlike(r"\S"))


def named(lines: DataFrame) -> DataFrame:
    """Adds ``node``, a 64-bit name of the line, and ``proof``, a second hash."""
    return lines.withColumn("node", F.xxhash64("line")).withColumn("proof", F.hash("line"))


def signatures(lines: DataFrame, names: DataFrame, scheme: Scheme = SCHEME) -> DataFrame:
    """``node``, ``rank``, ``planes`` and ``keys`` of every distinct line that is in ``names`` (``node`` and ``copies``).

    One permutation: a shingle's hash names its bin and competes there only, which costs a comparison of bins and not a
    minimum for each function. A bin without a shingle borrows the minimum of another, by a fixed order of its own
    (Shrivastava 2017), so that two lines share a bin's value with the probability of their similarity.

    Equal lines meet in the partial aggregate of each task, so a line that is everywhere is shuffled once per task.
    """
    k = scheme.k
    rows = lines.withColumn("node", F.xxhash64("line")).withColumn("chars", characters(F.col("line")))
    rows = rows.select("node", "chars", F.explode(starts(F.col("line"))).alias("start"))
    rows = rows.select("node", F.hash(shingle_at(F.col("chars"), F.col("start")), F.lit(scheme.seed)).alias("h"))
    rows = rows.withColumn("bin", F.col("h").bitwiseAND(F.lit(k - 1)))
    found = rows.groupBy("node").agg(*(F.expr(f"min(h) FILTER (WHERE bin = {i})").alias(f"m{i}") for i in range(k)))
    # both sides lie by node, so the merged minima move no further
    found = found.join(names.hint("shuffle_hash"), "node").withColumn("rank", most_first("copies", "node")).drop("copies")
    found = _apart(found).withColumn("least", F.least(*(F.col(f"m{i}") for i in range(k))))
    rng = random.Random(scheme.seed)
    for _ in range(2):
        others = [rng.sample([j for j in range(k) if j != i], min(BORROW, k - 1)) for i in range(k)]
        found = _apart(found).select("node", "rank", "least", *(F.coalesce(*(F.col(f"m{j}") for j in (i, *others[i]))).alias(f"m{i}") for i in range(k)))
    found = _apart(found).select("node", "rank", *(F.coalesce(f"m{i}", "least").alias(f"m{i}") for i in range(k)))
    # the lowest bits name the bin, those above them are as good as random
    shift, per = k.bit_length() - 1, 64 // scheme.bits
    nibble = lambda i: F.shiftrightunsigned(f"m{i}", shift).bitwiseAND(F.lit((1 << scheme.bits) - 1)).cast("long")
    planes = []
    for first in range(0, k, per):
        word = nibble(first)
        for i in range(first + 1, min(first + per, k)):
            word = word.bitwiseOR(F.shiftleft(nibble(i), scheme.bits * (i - first)))
        planes.append(word)
    keys = []
    for b in range(scheme.bands):
        key = F.xxhash64(F.lit(b), *(f"m{i}" for i in band(b, scheme)))
        keys.append(key.bitwiseAND(F.lit(~255)).bitwiseOR(F.lit(b)))
    return _apart(found).select("node", "rank", F.array(*planes).alias("planes"), F.array(*keys).alias("keys"))


def _apart(df: DataFrame) -> DataFrame:
    """The same partitions behind an operator that ends a generated method: a very long one would never be compiled."""
    return df.coalesce(1 << 30)


def unlike(a: Column, b: Column, scheme: Scheme = SCHEME) -> Column:
    """How many minima differ in the bits kept, which stand side by side in 64-bit words."""
    total, lowest = F.lit(0), sum(1 << at for at in range(0, 63, scheme.bits))
    for w in range(-(-scheme.k * scheme.bits // 64)):
        differ = a[w].bitwiseXOR(b[w])
        for step in (1, 2, 4)[: scheme.bits.bit_length() - 1]:
            differ = differ.bitwiseOR(F.shiftrightunsigned(differ, step))
        total = total + F.bit_count(differ.bitwiseAND(F.lit(lowest)))
    return total


def shared_enough(a: Column, b: Column, size_a: Column, size_b: Column, percent: int) -> Column:
    """Jaccard of two lines at least ``percent``; the sizes of their sets, which bound it, are looked at first."""
    possible = (100 * size_a >= percent * size_b) & (100 * size_b >= percent * size_a)
    return possible & ((100 + percent) * F.size(F.array_intersect(shingles_of(a), shingles_of(b))) >= percent * (size_a + size_b))


def bitmaps(found: DataFrame) -> DataFrame:
    """``node`` and ``map``, the bitmap of its line's set, of ``found`` (``node``, ``line``)."""
    each = found.select("node", characters(F.col("line")).alias("chars"), starts(F.col("line")).alias("starts"))
    each = each.select("node", "chars", F.explode("starts").alias("start"))
    each = each.select("node", F.xxhash64(shingle_at(F.col("chars"), F.col("start"))).alias("h"))
    word, bit = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(MAP_WORDS - 1)), F.expr("shiftleft(1L, CAST(h & 63 AS INT))")
    each = each.select("node", word.alias("word"), bit.alias("bit"))
    words = [F.coalesce(F.expr(f"bit_or(bit) FILTER (WHERE word = {w})"), F.lit(0).cast("long")) for w in range(MAP_WORDS)]
    return each.groupBy("node").agg(*(x.alias(f"w{w}") for w, x in enumerate(words))).select(
        "node", F.array(*(F.col(f"w{w}") for w in range(MAP_WORDS))).alias("map")
    )


def may_share_enough(a: Column, b: Column, size_a: Column, size_b: Column, percent: int) -> Column:
    """False only where the bitmaps prove that ``shared_enough`` is.

    A bit that differs needs a shingle of its own that the other set lacks, so bits that differ are never more than such
    shingles, and a pair at ``percent`` has (100 - percent) / (100 + percent) of both sizes of them at most.
    """
    differ = F.lit(0)
    for w in range(MAP_WORDS):
        differ = differ + F.bit_count(a[w].bitwiseXOR(b[w]))
    return (100 + percent) * differ <= (100 - percent) * (size_a + size_b)


def most_first(count: str, node: str) -> Column:
    """One number by which the largest ``count`` is first, of equals the smallest node.

    An aggregate by a number needs no sort, by a struct it does. Counts from 2^23 and nodes that agree in 40 bits are equal.
    """
    after = F.shiftrightunsigned(F.bitwise_not(F.col(node)).bitwiseXOR(F.lit(-(1 << 63))), 24)
    return F.shiftleft(F.least(F.col(count), F.lit((1 << 23) - 1)), 40).bitwiseOR(after)


def line_components(items: DataFrame, lines_of: Callable[[DataFrame], DataFrame], scheme: Scheme = SCHEME) -> DataFrame:
    """``node`` and ``root``, the smallest node linked with it, of all lines that have a link.

    ``items`` is the written table of ``signatures``; ``lines_of`` gives ``node`` and ``line`` of the nodes in a
    one-column table. Buckets hold names and packed bits only; a line is fetched when a pair it is in has passed the
    estimate.

    1. Every member of a bucket is compared with its leader, the member that occurs most often (of equals the smallest).
    2. In buckets of several components, members outside the bucket's main component are compared with those of other
       components. Two semi-joins on the bits keep the rows that have a partner at all, on either side; only these get
       their line and its bitmap. What the bitmaps leave is compared exactly, as part of the join's condition, so only
       links become rows, each in the first band it shares.
    """
    words = range(-(-scheme.k * scheme.bits // 64))
    bits = [F.col("planes")[w].alias(f"p{w}") for w in words]
    # both uses of ``banded`` read one exchange, so they ask for the same columns
    banded = items.select("node", "rank", *bits, F.explode("keys").alias("key")).where(F.col("key").isNotNull()).repartition("key")
    best = [F.max_by(c, "rank").alias(f"best_{c}") for c in ("node", *(f"p{w}" for w in words))]
    buckets = banded.groupBy("key").agg(F.count("*").alias("n"), *best).where(F.col("n") > 1)
    planes = F.array(*(f"p{w}" for w in words)).alias("planes")
    leader = F.struct(F.col("best_node").alias("node"), F.array(*(f"best_p{w}" for w in words)).alias("planes"))
    members = banded.join(buckets.hint("shuffle_hash"), "key")
    members = saved(members.select("key", "node", "n", "rank", planes, leader.alias("leader")), "buckets")
    other = F.col("leader.node")
    pairs = members.where((other != F.col("node")) & (unlike(F.col("planes"), F.col("leader.planes"), scheme) <= scheme.most_unlike))
    pairs = saved(pairs.select(F.least(other, "node").alias("a"), F.greatest(other, "node").alias("b")).distinct(), "pairs")
    found = saved(lines_of(pairs.select("a").union(pairs.select("b")).distinct()), "found")
    both = pairs.join(found.toDF("a", "line_a"), "a").join(found.toDF("b", "line_b"), "b")
    set_a, set_b = shingles_of(F.col("line_a")), shingles_of(F.col("line_b"))
    # written before they are compared: a filter would be moved to where the sets are made, and make them again
    shared, any_ = F.size(F.array_intersect(set_a, set_b)).alias("shared"), F.size(F.array_union(set_a, set_b)).alias("any")
    links = saved(both.select("a", "b", shared, any_), "measured").where(100 * F.col("shared") >= scheme.percent * F.col("any"))
    roots = saved(components(links.select("a", "b")), "roots")

    large = members.where(F.col("n") > 2).select("key", "node", "planes", other.alias("other"))
    large = large.join(roots.hint("shuffle_hash"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = large.groupBy("key", "root").agg(F.count("*").alias("members")).withColumn("rank", most_first("members", "root"))
    main = sizes.groupBy("key").agg(F.max_by("root", "rank").alias("main"), F.count("*").alias("roots"))
    rest = large.join(main.where(F.col("roots") > 1).hint("shuffle_hash"), "key").where(F.col("node") != F.col("other"))
    rest = saved(rest.select("key", "node", "root", "main", "planes"), "open")
    p = rest.where(F.col("root") != F.col("main")).alias("p")
    p = saved(p.join(rest.alias("q"), _against("p", "q", scheme), "left_semi"), "open-outside")
    q = saved(rest.alias("q").join(p.alias("p"), _against("q", "p", scheme), "left_semi"), "open-any")
    # a row outside whose partners are all in main components is no partner of another row outside: both sides are read
    found = saved(lines_of(p.select("node").union(q.select("node")).distinct()), "found")
    # a line is much smaller than its set, which is made where it is compared
    found = found.withColumn("size", F.size(F.array_distinct(shingles_of(F.col("line")))))
    keys = pick(items.select("node", "keys"), found.select("node"), "node")
    found = saved(found.join(bitmaps(found), "node").join(keys, "node"), "mapped")
    p, q = p.join(found, "node").alias("p"), q.join(found, "node").alias("q")
    number = F.col("p.key").bitwiseAND(F.lit(255)).cast("int")
    seen = F.exists(
        F.sequence(F.lit(0), F.greatest(number - 1, F.lit(0))),
        lambda i: (i < number) & (F.get("p.keys", i) == F.get("q.keys", i)),
    )
    once = (F.col("q.root") == F.col("q.main")) | (F.col("p.node") < F.col("q.node"))
    alike = shared_enough(F.col("p.line"), F.col("q.line"), F.col("p.size"), F.col("q.size"), scheme.percent)
    may = may_share_enough(F.col("p.map"), F.col("q.map"), F.col("p.size"), F.col("q.size"), scheme.percent)
    more = p.join(q, _against("p", "q", scheme) & once & may & ~seen & alike)
    more = more.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b"))
    more = saved(more.distinct(), "links")
    if more.isEmpty():
        return roots
    # the components found so far stand for their members
    low, high = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    joined = more.join(low, "a", "left").join(high, "b", "left")
    joined = joined.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    return saved(components(joined.union(roots.select("root", "node"))), "roots")


def _against(a: str, b: str, scheme: Scheme) -> Column:
    """Rows of one bucket and two components whose bits let a link be possible."""
    near = unlike(F.col(f"{a}.planes"), F.col(f"{b}.planes"), scheme) <= scheme.most_unlike
    return (F.col(f"{a}.key") == F.col(f"{b}.key")) & (F.col(f"{a}.root") != F.col(f"{b}.root")) & near


def line_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = SCHEME) -> tuple[DataFrame, DataFrame]:
    """The written places (``row``, ``line_no``, ``node``, ``proof``) of all lines that are not blank, and per ``node``
    and ``proof`` what its group keeps: ``keep`` (row and line_no) and ``group_size``. Lines alone in their group are left
    out of the second table.

    Exact copies are one node from the start, so a group is put together from one row per distinct line. Two different
    lines of one name (found by ``proof``) are not compared; they keep to their exact copies.
    """
    texts = texts_of(docs, id_col, text_col)
    places = saved(named(exploded(texts)).drop("line"), "lines")
    firsts = places.groupBy("node", "proof").agg(F.min(F.struct("row", "line_no")).alias("first"), F.count("*").alias("copies"))
    firsts = saved(firsts, "distinct-lines")
    names = firsts.groupBy("node").agg(F.sum("copies").alias("copies"), F.count("*").alias("proofs"))
    names = names.where(F.col("proofs") == 1).drop("proofs")
    items = saved(signatures(exploded(texts), names, scheme), "line-signatures")

    def lines_of(nodes: DataFrame) -> DataFrame:
        nodes = saved(nodes.toDF("node"), "nodes")
        holders = pick(firsts, nodes, "node").select("first.row")
        return pick(named(exploded(pick(texts, holders, "row"))), nodes, "node").groupBy("node").agg(F.min("line").alias("line"))

    roots = line_components(items, lines_of, scheme)
    roots = roots.select("node", "root").union(roots.select(F.col("root").alias("node"), "root").distinct())
    # lines without a link are grouped with their exact copies; ``proof`` keeps apart those whose names clash
    lone = F.when(F.col("root").isNull(), F.col("proof"))
    nodes = firsts.join(roots.hint("shuffle_hash"), "node", "left").where((F.col("copies") > 1) | F.col("root").isNotNull())
    nodes = saved(nodes.withColumn("lone", lone).withColumn("root", F.coalesce("root", "node")), "grouped")
    groups = nodes.groupBy("root", "lone").agg(F.min("first").alias("keep"), F.sum("copies").alias("group_size"))
    groups = groups.select(F.col("root").alias("g"), F.col("lone").alias("l"), "keep", "group_size")
    found = nodes.join(groups, (F.col("root") == F.col("g")) & F.col("lone").eqNullSafe(F.col("l")))
    return places, found.select("node", "proof", "keep", "group_size")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = SCHEME) -> DataFrame:
    """One row per line that is not blank: ``doc_id``, ``line_no``, ``keep_doc``, ``keep_line``, ``group_size``, ``kept``.

    Lines are compared in lower case. Two lines are near copies when their sets of character shingles (every run of
    5 characters; a shorter line is one shingle) have a Jaccard similarity of at least 0.8; groups are the components of these
    links, and the line with the smallest document id (null first), then line number stays. Blank lines and null or
    empty texts have no rows and are never removed. Rows that repeat an id and its text share one verdict. Other columns
    are ignored. An empty table gives an empty result.
    """
    places, groups = line_groups(docs, id_col, text_col, scheme)
    rows = places.join(groups, ["node", "proof"], "left")
    rows = rows.withColumn("keep", F.coalesce("keep", F.struct("row", "line_no"))).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    return rows.select(
        F.col("row.id").alias("doc_id"),
        "line_no",
        F.col("keep.row.id").alias("keep_doc"),
        F.col("keep.line_no").alias("keep_line"),
        "group_size",
        ((F.col("row") == F.col("keep.row")) & (F.col("line_no") == F.col("keep.line_no"))).alias("kept"),
        F.col("row.hash").alias("text_hash"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = SCHEME) -> DataFrame:
    """``docs`` with all columns, each text without the lines that another one stands for.

    A document none of whose lines stays is dropped; one that had no lines to begin with stays as it is.
    """
    names = docs.columns
    gone = line_dedup(docs, id_col, text_col, scheme).where(~F.col("kept"))
    gone = gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "gone")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("d"))
    text = F.col(f"d.`{text_col}`")
    same = F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("gone_id")) & (F.xxhash64(text) == F.col("gone_hash"))
    rows = rows.join(gone, same, "left").withColumn("parts", F.when(F.col("gone").isNotNull(), F.split(text, "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    shorter = F.array_join(F.transform(left, lambda i: F.get("parts", i)), "\n")
    rows = rows.withColumn("shorter", F.when(F.col("gone").isNotNull(), shorter))
    rows = rows.where(F.col("shorter").isNull() | F.col("shorter").rlike(r"\S"))
    return rows.select(*(F.coalesce("shorter", text).alias(c) if c == text_col else F.col(f"d.`{c}`").alias(c) for c in names))
