"""Merkle manifest against brute force: log positions, roots, proofs, tampering, odd rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from alertflow.llm import manifest, registry

from .conftest import ODD, frame


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def piece(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(row, more=0):
    doc_id, source, lang, n_chars, text = row
    n_chars = None if n_chars is None else n_chars + more
    return sha("".join(map(piece, (doc_id, source, lang, n_chars, text))))


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def way(tree, i):
    out = []
    for level in tree[:-1]:
        other = i ^ 1
        out.append((level[other] if other < len(level) else None, other < i))
        i //= 2
    return out


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for x in langs:
        order = sorted(trees[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        built[x] = (order, levels([leaf_of(r) for r in order]))
    top = levels([built[x][1][-1][0] for x in langs])
    out = []
    for t, x in enumerate(langs):
        order, tree = built[x]
        for i, r in enumerate(order):
            steps = way(tree, i) + way(top, t)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            cur = leaf_of(r, 1 if hit else 0)
            for sib, left in steps:
                cur = sha(cur if sib is None else sib + cur if left else cur + sib)
            proof = sha("".join(s for s, _ in steps if s))
            out.append((str(r[0]), tree[0][i], tree[-1][0], top[-1][0], proof, cur, cur == top[-1][0]))
    return sorted(out)


def proofs(docs):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest.build_manifest(docs, changed={"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}, when=hit)


def found(df):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def test_query_on_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = registry.queries()["op13_merkle_manifest"](spark, small)
    assert found(got) == brute(rows)


@pytest.fixture(scope="module")
def made(spark):
    """A tree of three runs, one of exactly one run, lone leaves, a null tree, nulls in every column, repeated ids."""
    rng = random.Random(4)
    rows = [(k, f"s{k % 3}", "big", k, f"text {rng.random()}") for k in range(2 * 1024 + 313)]
    rows += [(k, None, None, None, None) for k in range(1024)] + [(None, "s", "big", 3, "x")] * 3 + [(5, "s", "big", 2**63 - 1, "é\0")] * 2
    rows += [(7, "", "z" + chr(0xFFFF), 0, ""), (9, "a", "z" + chr(0x10000), 1, "b"), (9, "a", "", 1, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    return rows, docs.withColumn("tree", F.lit("clash")).withColumn("nodes", F.lit(1)).repartition(5)


def test_trees_of_many_runs(made):
    rows, docs = made
    got = proofs(docs)
    assert found(got.proofs()) == brute(rows)


def test_log_is_postorder_without_gaps(made):
    rows, docs = made
    got = proofs(docs)
    nodes = got.nodes().collect()
    sizes = {r.tree: r.n for s in got.log[:1] for r in s.select("tree", "n").distinct().collect()}
    assert sorted(sizes.values()) == [1, 1, 1, 1024, 2366]
    for tree, n in sizes.items():
        of = {(r.height, r.place): r.digest for r in nodes if r.tree == tree}
        assert len(of) == sum(r.tree == tree for r in nodes)
        at = {k: manifest.position(*k, n) for k in of}
        assert sorted(at.values()) == list(range(len(of)))
        for (h, i), digest in of.items():
            if h:
                below = [k for k in ((h - 1, 2 * i), (h - 1, 2 * i + 1)) if k in of]
                assert digest == sha("".join(of[k] for k in below)) and all(at[k] < at[(h, i)] for k in below)


def test_paths_lead_to_the_root(made):
    got = proofs(made[1])
    leaves = {(r.doc_id, r.leaf) for r in got.proofs().collect()}
    root = got.root
    ends = [(r.doc_id, bytes(r.path)) for r in got.paths().collect()]
    assert len(ends) == len(made[0])
    by_id = {}
    for doc, leaf in leaves:
        by_id.setdefault(doc, []).append(bytes.fromhex(leaf))
    assert all(any(manifest.fold(x, path) == root for x in by_id[doc]) for doc, path in ends)


@pytest.mark.parametrize("n", [*range(1, 40), 64, 127, 128, 200])
def test_positions_of_one_run(n):
    leaves = [bytes([k % 256, k // 256]) * 16 for k in range(n)]
    for levels_ in {manifest.height_of(n), manifest.HEIGHT}:
        log = manifest.grow(leaves, levels_)
        level, want = leaves, {}
        for h in range(levels_ + 1):
            want |= {manifest.position(h, i, n): x for i, x in enumerate(level)}
            level = [manifest.parent(*level[k : k + 2]) for k in range(0, len(level), 2)]
        assert [want[k] for k in range(len(want))] == log
        path = manifest.steps(b"".join(log), n - 1, n, levels_)
        assert manifest.fold(leaves[-1], path) == log[-1]


def test_odd_rows(spark, odd, empty):
    rows = [(i, "s", None, None, t) for i, t in ODD]
    assert found(proofs(odd).proofs()) == brute(rows)
    assert proofs(empty) is None
    one = frame(spark, [(3, "only")])
    got = proofs(one).proofs().collect()
    assert [(r.leaf == r.subroot == r.root, r.proof_sha256, r.verified) for r in got] == [(True, sha(""), True)]
