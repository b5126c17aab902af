"""Near copies of sets by b-bit MinHash: bands for candidates, bit counts to thin them, full sets to confirm."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertflow.llm.common import components, cut, saved

#: Nodes whose ids may be broadcast to pick their texts from the scan, at 8 bytes each; more are joined by a shuffle.
BROADCAST_NODES = 2_000_000


@dataclass(frozen=True)
class Scheme:
    """Bands of minima and the similarity wanted, in hundredths.

    With ``rows`` minima in a band and ``bands`` of them, a pair at the wanted similarity s stays unseen with
    probability (1 - s^rows)^bands. ``bits`` low bits of each minimum are kept for the estimate.
    """

    percent: int = 85
    rows: int = 7
    bands: int = 48
    bits: int = 4
    seed: int = 11
    #: Standard deviations by which an estimate may fall short before its pair is given up.
    slack: float = 5.5
    #: Sets are small enough to travel with their bands, so that the second step confirms inside its join.
    small_sets: bool = False
    #: Minima in all: fewer than the bands hold where bands share them, more where the estimate is to be sharper.
    minima: int = 0

    @property
    def k(self) -> int:
        return self.minima or self.rows * self.bands

    @property
    def words(self) -> int:
        """64-bit words of one bit plane."""
        return -(-self.k // 64)

    @property
    def most_unlike(self) -> int:
        """Minima that may differ in their low bits. Low bits agree by chance once in 2^bits, which is corrected for."""
        q = (1 - self.percent / 100) * (1 - 0.5**self.bits)
        return math.ceil(self.k * q + self.slack * math.sqrt(self.k * q * (1 - q)))


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``n`` words; of fewer words, of the whole sequence."""
    if not words:
        return np.empty(0, np.uint64)
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = min(n, len(words))
    of = xxhash.xxh3_64_intdigest
    hashes = [of(text[a:b]) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)]
    return np.unique(np.asarray(hashes, np.uint64))


class Signer:
    """Minima of many sets at once."""

    #: Elements handled together, so that they stay in the processor's cache.
    BLOCK = 60_000

    def __init__(self, scheme: Scheme):
        self.scheme = scheme
        rng = np.random.default_rng(scheme.seed)
        self.flip = rng.integers(0, 1 << 32, scheme.k, dtype=np.uint32)
        self.times = rng.integers(0, 1 << 32, scheme.k, dtype=np.uint32) | np.uint32(1)

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row per set, none of which may be empty."""
        out = np.empty((len(sets), self.scheme.k), np.uint32)
        at = 0
        while at < len(sets):
            end, n = at, 0
            while end < len(sets) and (end == at or n + len(sets[end]) <= self.BLOCK):
                n += len(sets[end])
                end += 1
            x = np.concatenate(sets[at:end])
            x = (x ^ (x >> np.uint64(32))).astype(np.uint32)
            offsets = np.cumsum([0, *map(len, sets[at : end - 1])])
            work = np.empty_like(x)
            for i in range(self.scheme.k):
                np.bitwise_xor(x, self.flip[i], out=work)
                np.multiply(work, self.times[i], out=work)
                out[at:end, i] = np.minimum.reduceat(work, offsets)
            at = end
        return out

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """A 64-bit key per band; its low 8 bits are the band's number."""
        n, s = len(minima), self.scheme
        rows = minima[:, : s.bands * s.rows].reshape(n, s.bands, s.rows).astype(np.uint64)
        key = np.broadcast_to(np.arange(s.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (n, s.bands)).copy()
        for r in range(s.rows):
            key = (key ^ rows[:, :, r]) * np.uint64(0xC2B2AE3D27D4EB4F)
            key ^= key >> np.uint64(29)
        key = (key & ~np.uint64(255)) | np.arange(s.bands, dtype=np.uint64)
        return key.view(np.int64)

    def planes(self, minima: np.ndarray) -> np.ndarray:
        """Low bits of the (mixed) minima as ``bits`` planes of packed 64-bit words."""
        s = self.scheme
        mixed = (minima * np.uint32(0x9E3779B1)) >> np.uint32(32 - s.bits)
        padded = np.zeros((len(minima), s.words * 64), np.uint8)
        out = []
        for bit in range(s.bits):
            padded[:, : s.k] = (mixed >> np.uint32(bit)) & np.uint32(1)
            out.append(np.packbits(padded, axis=1).view(np.int64))
        return np.concatenate(out, axis=1)


def unlike(a: Column, b: Column, scheme: Scheme) -> Column:
    """How many minima differ in their low bits: one bit count per 64 of them."""
    total = F.lit(0)
    for w in range(scheme.words):
        differ = None
        for plane in range(scheme.bits):
            at = plane * scheme.words + w
            x = a[at].bitwiseXOR(b[at])
            differ = x if differ is None else differ.bitwiseOR(x)
        total = total + F.bit_count(differ)
    return total


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, as_set: Callable[[Column], Column] | None = None) -> DataFrame:
    """Pairs ``a``, ``b`` whose full sets have 100 * intersection >= percent * union."""
    a = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(a, "a").join(b, "b")
    return both.where(similar(F.col("set_a"), F.col("set_b"), percent, as_set)).select("a", "b")


def similar(a: Column, b: Column, percent: int, as_set: Callable[[Column], Column] | None = None) -> Column:
    """(100 + percent) * intersection >= percent * sum of the sizes, which is the Jaccard condition."""
    if as_set:
        # each set is made once: an expression used twice would be worked out twice
        both = F.array(F.struct(as_set(a).alias("a"), as_set(b).alias("b")))
        return F.exists(both, lambda x: similar(x["a"], x["b"], percent))
    return (100 + percent) * F.size(F.array_intersect(a, b)) >= percent * (F.size(a) + F.size(b))


def near_components(
    items: DataFrame,
    sets_of: Callable[[DataFrame], DataFrame],
    scheme: Scheme,
    as_set: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``node`` and ``root``, the smallest node linked with it, of all nodes that have a link.

    ``items`` has one row per distinct set: ``node`` (long), ``weight`` (how often it occurs), ``planes``, ``keys``.
    ``sets_of`` returns ``node`` and
    ``set`` (array of long, or what ``as_set`` makes one from) of the nodes in a one-column table. It must be a written
    table: it is read several times.

    Links are found in two steps, so that a bucket of m near copies costs about m rows and not m * m:

    1. every member of a bucket is compared with its leader, the member that occurs most often (of equals the smallest
       node), which in a group of edited copies is the original;
    2. in buckets whose members still lie in several components, each member outside the bucket's main component is
       compared with all members of other components. The comparison is a join condition on the packed bits, so only
       pairs that pass the estimate, each in the first band it shares, become rows.

    Pairs inside one component need no further look, as they cannot change the result; all others that share a band are
    compared. Both steps confirm on the full sets; where sets are small, the second does so in the join condition itself,
    and only links become rows.
    """
    banded = items.select("node", "weight", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.max("weight").alias("top"), F.count("*").alias("n"))
    members = saved(banded.join(buckets.where(F.col("n") > 1), "key"), "members")
    leaders = members.where(F.col("weight") == F.col("top")).groupBy("key").agg(F.min("node").alias("leader"))
    members = saved(members.select("key", "node", "n").join(leaders, "key"), "buckets")
    pair = (F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b"))
    pairs = members.where(F.col("leader") != F.col("node")).select(*pair).distinct()
    bits = items.select("node", "planes")
    first = bits.select(F.col("node").alias("a"), F.col("planes").alias("planes_a"))
    second = bits.select(F.col("node").alias("b"), F.col("planes").alias("planes_b"))
    alike = unlike(F.col("planes_a"), F.col("planes_b"), scheme) <= scheme.most_unlike
    pairs = saved(pairs.join(first, "a").join(second, "b").where(alike).select("a", "b"), "pairs")
    sets = saved(sets_of(members.where(F.col("n") > 2).select("node").union(pairs.select("a")).union(pairs.select("b"))
                         .distinct()), "sets")
    links = saved(confirm(pairs, sets, scheme.percent, as_set), "links")
    roots = saved(components(links), "roots")

    large = members.where(F.col("n") > 2)
    large = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = large.groupBy("key", "root").agg(F.count("*").alias("size"))
    main = sizes.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.count("*").alias("roots"))
    open_ = large.join(main.where(F.col("roots") > 1), "key").where(F.col("node") != F.col("leader"))
    open_ = open_.join(items, "node").select("key", "node", "root", "main", "planes", "keys")
    open_ = cut(open_.join(sets, "node") if scheme.small_sets else open_)
    p = open_.where(F.col("root") != F.col("main")).select(*(F.col(c).alias(f"{c}_p") for c in open_.columns))
    q = open_.select(*(F.col(c).alias(f"{c}_q") for c in open_.columns if c != "main"))
    band = F.col("key_p").bitwiseAND(F.lit(255)).cast("int")
    seen = F.exists(
        F.sequence(F.lit(0), F.greatest(band - 1, F.lit(0))),
        lambda i: (i < band) & (F.get("keys_p", i) == F.get("keys_q", i)),
    )
    enough = similar(F.col("set_p"), F.col("set_q"), scheme.percent, as_set) if scheme.small_sets else F.lit(True)
    rest = p.join(
        q,
        (F.col("key_p") == F.col("key_q"))
        & (F.col("root_p") != F.col("root_q"))
        & ((F.col("root_q") == F.col("main_p")) | (F.col("node_p") < F.col("node_q")))
        & (unlike(F.col("planes_p"), F.col("planes_q"), scheme) <= scheme.most_unlike)
        & ~seen
        & enough,
    ).select(F.least("node_p", "node_q").alias("a"), F.greatest("node_p", "node_q").alias("b")).distinct()
    more = saved(rest if scheme.small_sets else confirm(rest, sets, scheme.percent, as_set), "links")
    if more.isEmpty():
        return roots
    # the components found so far stand for their members
    low, high = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    joined = more.join(low, "a", "left").join(high, "b", "left")
    joined = joined.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    return saved(components(joined.union(roots.select("root", "node"))), "roots")


def pick(rows: DataFrame, nodes: DataFrame, on: str) -> DataFrame:
    """Rows whose ``on`` is among ``nodes``; the ids are broadcast while they are few, so texts need no shuffle."""
    nodes = nodes.select(F.col(nodes.columns[0]).alias(on)).distinct()
    nodes = F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes
    return rows.join(nodes, on, "left_semi")
