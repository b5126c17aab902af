"""Mixing against brute force: sizes, targets, copies, the mix itself, odd rows."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from alertflow.llm import mixing, registry

from .conftest import ODD, frame


def size(text):
    return len(re.findall(r"[^ \t-\r]+", text or ""))


def brute_targets(sizes):
    """Exact targets of sources by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    out, open_ = {}, set(order)
    left = Fraction(3, 2) * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not above:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: Fraction(2 * sizes[s]) for s in above}
        left -= sum(2 * sizes[s] for s in above)
        open_ -= above
    return out


def draw(doc_id, text):
    name = ("-" if doc_id is None else str(doc_id)) + ":" + hashlib.md5((text or "").encode()).hexdigest()
    return int(hashlib.md5(name.encode()).hexdigest()[:13], 16)


def brute(rows):
    sizes, members = Counter(), defaultdict(list)
    for i, s, t in rows:
        sizes[s] += size(t)
        members[s].append((i, size(t), draw(i, t)))
    targets = brute_targets(sizes)
    out = []
    for s, docs in members.items():
        target = float(targets[s])
        rate = target / sizes[s] if sizes[s] else 0.0
        whole, limit = int(rate), int((rate - int(rate)) * mixing.SPAN)
        taken = lambda j: [whole + ((d + j * mixing.STEP) % mixing.SPAN < limit) for _, _, d in docs]  # noqa: B023, E731
        tried = [abs(sum(n * c for (_, n, _), c in zip(docs, taken(j), strict=True)) - target) for j in range(mixing.SEEDS)]
        best = taken(tried.index(min(tried)))
        out += [(str(i), n, sizes[s], n * c, c) for (i, n, _), c in zip(docs, best, strict=True)]
    return sorted(out), {s: float(t) for s, t in targets.items()}


def check(rows, docs):
    got = mixing.plan(docs).collect()
    want, targets = brute(rows)
    assert sorted((str(r.doc_id), r.size, r.source_size, r.taken, r.copies) for r in got) == want
    for r in got:
        assert abs(r.target - targets[r.source]) <= 1e-9 * max(1.0, targets[r.source])
    return got


def test_query_on_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = check([tuple(r) for r in docs.select("doc_id", "source", "text").collect()], docs)
    query = registry.queries()["op12_source_mixing"](spark, small).collect()
    assert sorted((r.doc_id, r.taken, r.target) for r in query) == sorted((r.doc_id, r.taken, r.target) for r in got)
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
        by[r.source][2] = max(by[r.source][2], r.size)
        assert r.taken <= 2 * r.size
    for taken, target, _ in by.values():
        assert abs(taken - target) < 0.02 * target


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 10, "b": 1000, "c": 1000, None: 5}, {"a": 1}, {"a": 0, "b": 0}, {"a": 0, "b": 7}, {None: 3},
        {chr(97 + k): 3**k for k in range(12)}, {chr(97 + k): 4**k for k in range(12)}, {"z": 5, "￿": 5, "\U00010000": 5, "": 5},
    ],
)
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(table.repartition(3)).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in want)
    assert abs(sum(got.values()) - 1.5 * sum(sizes.values())) <= 1e-6 * max(1, sum(sizes.values()))


def test_odd_rows_and_a_hot_source(spark, odd, empty):
    check([(i, "s", t) for i, t in ODD], odd)
    assert mixing.plan(empty).count() == 0 and mixing.mixed(empty).count() == 0
    rows = [(k, "hot" if k % 3 else ("cold", "warm", None)[k % 9 // 3], "w " * (k % 50)) for k in range(3000)] + [(1, "hot", "same text")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"rate": F.lit("x"), "r": F.lit(1), "copies": F.lit("c")})
    got = check(rows, docs.repartition(6))
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    want = Counter()
    for r in got:
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mix.collect()) == +want


def test_very_long_text(spark):
    text = "word " * 400_000
    got = mixing.plan(frame(spark, [(1, text), (2, "a b")])).collect()
    assert sorted((r.doc_id, r.size) for r in got) == [(1, 400_000), (2, 2)]
