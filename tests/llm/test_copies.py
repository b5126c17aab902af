"""Exact and near copies, lines and passages against brute force."""

import re
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alertflow.llm import exact, lines, minhash, passages
from alertflow.llm.common import CLEANUP, components, saved
from alertflow.llm.near import Scheme

from .conftest import ODD, frame


def roots_of(n, links):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def ascii_words(text):
    return (text or "").encode().lower().split()


def word_set(text, n=5):
    w = ascii_words(text)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def links_of(sets, percent):
    holders, links = defaultdict(list), set()
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    for k, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for other in holders[x]:
                if other < k:
                    common[other] += 1
        links |= {(o, k) for o, n in common.items() if 100 * n >= percent * (len(s) + len(sets[o]) - n)}
    return links


def near_copies(n, words=120, seed=2):
    """A dense group: copies of one text with a few words changed each, in which only some pairs are linked."""
    import random

    rng = random.Random(seed)
    base = [f"b{k}" for k in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append((k, " ".join(w)))
    return out


def check_near(spark, rows, docs, scheme):
    got = sorted(map(tuple, minhash.near_duplicates(docs, scheme=scheme).collect()), key=str)
    rows = sorted(((i, t) for i, t in rows if i is not None), key=lambda r: r[0])
    sets = [word_set(t) for _, t in rows]
    top = roots_of(len(rows), links_of(sets, scheme.percent))
    want = [(i, len(s), rows[r][0], rows[r][0] == i) for (i, _), s, r in zip(rows, sets, top, strict=True)]
    assert [g for g in got if g[0] is not None] == sorted(want, key=str)
    assert all(g[2] is None and g[3] for g in got if g[0] is None)


def test_near_duplicates_of_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check_near(spark, [tuple(r) for r in docs.select("doc_id", "text").collect()], docs, minhash.SCHEME)


def test_near_duplicates_of_a_dense_group(spark):
    rows = near_copies(400) + [(1000 + k, t) for k, t in near_copies(60, 200, 3)]
    check_near(spark, rows, frame(spark, rows).repartition(5), Scheme(percent=85))
    check_near(spark, rows, frame(spark, rows).repartition(5), Scheme(percent=92))


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    check_near(spark, ODD, odd, minhash.SCHEME)
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in ODD if i not in (5, 6, 8))


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 150)] + [(149, 160), (200, 201), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = dict.fromkeys(range(1, 61), 0) | dict.fromkeys([*range(101, 150), 160], 100) | {201: 200}
    assert got == want


def test_shuffle_files_go_when_a_table_is_written(spark):
    def shuffled():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {x for x in (found.apply(k).getName() for k in range(found.size())) if x.startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(CLEANUP)
    written = saved(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    assert not shuffled() - before and spark.conf.get(CLEANUP) == setting
    assert sorted(r["count"] for r in written.collect()) == [142] + [143] * 6


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[ \t-\r]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    return {k: (sorted(v, key=lambda x: x[:3])[0][3], len(v)) for k, v in groups.items()}


def test_exact_dedup(spark, odd, empty, small):
    many = [(k, ("Same text" if k % 3 else f"t {k % 50}") + " " * (k % 7)) for k in range(3000)]
    big = spark.read.parquet(f"{small}/documents.parquet")
    for rows, docs in ((ODD, odd), (many, frame(spark, many).repartition(7)), ([tuple(r) for r in big.select("doc_id", "text").collect()], big)):
        want = brute_exact(rows)
        import hashlib

        expect = sorted(
            (str(i), str(want[n][0]), want[n][1], hashlib.sha256(n.encode()).hexdigest())
            for i, t in rows for n in [re.sub(r"[ \t-\r]", "", t or "")]
        )
        got = exact.exact_dedup(docs).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == expect
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert exact.exact_dedup(empty).count() == 0


def test_runs_merge_over_small_batches():
    rows = [(0, bytes([k // 3]), 1, 1, 5, k, 1) for k in range(30)]
    names = ["slot", "digest", "proof", "n_bytes", "points", "doc_id", "group_size"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[k : k + 4]]) for k in range(0, 30, 4)]
    got = [tuple(r.values()) for b in exact._merge(iter(batches)) for r in b.to_pylist()]
    assert got == [(0, bytes([k]), 1, 1, 5, 3 * k, 3) for k in range(10)]


def brute_lines(rows):
    at = [(i, k, line.lower()) for i, t in rows for k, line in enumerate((t or "").split("\n")) if re.search(r"[^ \t-\r]", line)]
    at.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    sets = [dense_set(x[2]) for x in at]
    top = roots_of(len(at), links_of(sets, 80))
    return sorted((str(i), k, str(at[r][0]), at[r][1]) for (i, k, _), r in zip(at, top, strict=True))


def test_line_dedup(spark, empty, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    words = "one upon times there lived some other king whose name nobody knew until today because storms came".split()
    lines_ = [" ".join(w if k % len(words) != j else w + "s" for j, w in enumerate(words * 3)) for k in range(12)]
    made = [(k, f"{lines_[k]}\nCommon line here.\n\n  \nown{k} line{k} of{k} words{k}") for k in range(12)]
    made += [(50, None), (51, ""), (52, "\n\n"), (None, "Common line here."), (53, "COMMON LINE HERE.\ncommon line here.")]
    for rows, frame_ in ((made, frame(spark, made).repartition(3)), ([tuple(r) for r in docs.select("doc_id", "text").collect()], docs)):
        got = lines.line_dedup(frame_).collect()
        assert sorted((str(r.doc_id), r.line_no, str(r.keep_doc), r.keep_line) for r in got) == brute_lines(rows)
        assert all(r.kept == ((r.doc_id, r.line_no) == (r.keep_doc, r.keep_line)) for r in got)
        left = lines.without_repeats(frame_)
        assert left.columns == frame_.columns
        kept = {(r.doc_id, r.line_no) for r in got if r.kept}
        for r in left.collect():
            text = next(t for i, t in rows if i == r.doc_id)
            want = [x for k, x in enumerate((text or "").split("\n")) if (r.doc_id, k) in kept or not re.search(r"\S", x)]
            assert (r.text or "") == "\n".join(want)
        gone = {i for i, _ in rows} - {r.doc_id for r in left.collect()}
        assert all(not any(d == i for d, _ in kept) for i in gone)
    assert lines.line_dedup(empty).count() == 0 and lines.without_repeats(empty).count() == 0


@pytest.fixture(scope="module")
def planted():
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(50) for _ in range(5)]
    rows, want = [], set()
    for k in range(60):
        parts = [text(rng.randint(0, 80)) for _ in range(3)]
        if k < 40:
            p = shared[k % 5]
            p = p.upper() if k % 3 == 0 else p.replace(" ", "\n", 3) if k % 3 == 1 else p.replace(" ", "  ")
            parts.insert(rng.randint(0, 3), p)
            want.add(k)
        rows.append((k, " ".join(parts) if k % 2 else "  ".join(parts) + " é"))
    long = text(120)
    for k in range(60, 64):  # near copies of a long line
        w = long.split()
        w[k - 20] = "changed"
        rows.append((k, f"{text(20)}\n{' '.join(w)}\n{text(20)}"))
        want.add(k)
    return rows, want


def test_passages(spark, planted, odd, empty):
    rows, want = planted
    docs = frame(spark, rows).repartition(4)
    found = passages.repeated_passages(docs).cache()
    assert {r.doc_id for r in found.collect()} == want
    texts = dict(rows)
    for r in found.where("kind = 'passage'").collect():
        here = texts[r.doc_id].encode()[r.start : r.end].lower().split()
        assert len(here) >= 32
        there = texts[r.keep_doc].encode()[r.keep_start :].lower().split()
        assert here == there[: len(here)]
    lines_found = found.where("kind = 'paragraph'").select("doc_id", "keep_doc").distinct().collect()
    assert {tuple(r) for r in lines_found if r.doc_id >= 60} == {(k, 60) for k in range(60, 64)}
    removed = {r.doc_id: r.text for r in passages.remove_passages(docs, found).collect()}
    assert removed.keys() == texts.keys()
    assert all(removed[k] == texts[k] for k in texts if k not in want)
    again = passages.repeated_passages(frame(spark, list(removed.items())))
    assert again.count() == 0
    assert {r.doc_id for r in passages.repeated_passages(odd).collect()} == {7, 8}
    assert passages.repeated_passages(empty).count() == 0


def test_winnowing_meets_in_every_copy():
    import random

    rng = random.Random(1)
    word = lambda: rng.choice("the of and to in tion er re".split()) + rng.choice("abc")
    for _ in range(300):
        shared = [word() for _ in range(50)]
        runs = []
        for _ in range(2):
            t = passages.Text(" ".join([word() for _ in range(rng.randint(0, 40))] + shared + [word() for _ in range(rng.randint(0, 40))]).encode())
            runs.append({t.run(a, passages.PASSAGE) for a in t.anchors().tolist()})
        assert runs[0] & runs[1]


def test_words_shingles_and_anchors_are_those_of_the_plain_definitions():
    import random

    import xxhash

    rng = random.Random(7)
    made = ["", " \n ", "one", "a b " * 90, "w " * 50 + "\n\n" + "v " * 32, "É ü\x0bZ " * 60]
    for words in (1, 2, 300):  # few words: many equal hashes among neighbours
        for _ in range(40):
            made.append("".join(f"W{rng.randrange(words)}" + rng.choice([" ", " ", " ", "  ", "\n", "\n\t\n"]) for _ in range(rng.randint(1, 200))))
    for text in made:
        t, words = passages.Text(text.encode()), ascii_words(text)
        assert [t.raw[a:b].lower() for a, b in zip(t.starts, t.ends, strict=True)] == words
        assert [t.run(k, 1) for k in range(len(words))] == words
        hashes = [xxhash.xxh3_64_intdigest(b" ".join(words[k : k + 5])) for k in range(len(words) - 4)]
        assert t.hashes.tolist() == hashes
        h = hashes[: max(len(words) - 31, 0)]
        runs = [range(k, k + 19) for k in range(len(h) - 18)] or [range(len(h))] * bool(h)
        assert t.anchors().tolist() == sorted({min(r, key=lambda k: (h[k], k)) for r in runs})
        for first, n in t.paragraphs():
            assert t.set_of(first, n).tolist() == sorted(set(hashes[first : first + n - 4]))


def dense_set(line):
    return {line[k : k + 5] for k in range(max(1, len(line) - 4))}


def test_lines_are_compared_in_full(spark, empty):
    """Lines without spaces, and short lines with one word changed."""
    import random

    rng = random.Random(4)
    url = "https://www.youtube.com/watch?v="
    run = "".join(rng.choice("abcdefghijklmnop") for _ in range(120))
    made = [f"{url}abc", f"{url}zzzqqqxxxyyy", f"{url}kkkkkkkkkkkkkkk1", "https://www.yout", run, "Q" + run[1:], run[:16] + run[60:],
            "今天天气很好我们一起去公园散步吧然后回家", "今天天气很好我们一起去公园散步吧然后回学校写作业看电视", "ab", "abcd", "\U0001f600" * 4, "\U0001f600" * 9]
    for _ in range(40):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(14, 24))]
        made.append(" ".join(words))
        words[rng.randrange(len(words))] = "other"
        made.append(" ".join(words))
    lower = [x.lower() for x in made]
    links = links_of([dense_set(x) for x in lower], 80)
    top = roots_of(len(made), links)
    rows = list(enumerate(made))
    got = sorted((r.doc_id, r.keep_doc) for r in lines.line_dedup(frame(spark, rows).repartition(3)).collect())
    assert got == list(enumerate(top))
    assert len(links) > 30 and top[0] != top[1] and top[4] == top[5] != top[6]


def test_a_line_apart_from_the_leader_meets_the_other_members(spark):
    """B is like A and like C, which are not alike; A occurs twice and so leads the buckets."""
    import random

    rng = random.Random(9)
    made = []
    for _ in range(12):
        a = [rng.choice("abcdefghijklmnop") for _ in range(700)]
        b, c = list(a), list(a)
        for k in range(8):
            b[30 + 40 * k] = c[30 + 40 * k] = "x"
            c[370 + 40 * k] = "z"
        made += ["".join(x) for x in (a, a, b, c)]
    links = links_of([dense_set(x) for x in made], 80)
    assert all((4 * k, 4 * k + 2) in links and (4 * k + 2, 4 * k + 3) in links and (4 * k, 4 * k + 3) not in links for k in range(12))
    got = {r.doc_id: (r.keep_doc, r.group_size) for r in lines.line_dedup(frame(spark, list(enumerate(made))).repartition(3)).collect()}
    assert got == {k: (k // 4 * 4, 4) for k in range(48)}


def test_bitmaps_reject_no_link(spark):
    """Whatever the bitmaps reject is no pair at 0.8, and they reject most others."""
    import random

    rng = random.Random(12)
    made = []
    for n in (6, 40, 150, 400, 1500):
        base = [rng.choice("abcdefgh é") for _ in range(n)]
        made += ["".join(x if rng.random() >= part else rng.choice("ijkl") for x in base) for part in (0, 0.004, 0.008, 0.012, 0.02, 0.04, 0.1, 1)]
    rows = spark.createDataFrame(list(enumerate(made)), "node long, line string")
    rows = rows.withColumn("size", F.size(F.array_distinct(lines.shingles_of(F.col("line"))))).join(lines.bitmaps(rows), "node").cache()
    a, b = rows.alias("a"), rows.alias("b")
    may = lines.may_share_enough(F.col("a.map"), F.col("b.map"), F.col("a.size"), F.col("b.size"), 80)
    kept = {tuple(r) for r in a.join(b, F.col("a.node") < F.col("b.node")).where(may).select("a.node", "b.node").collect()}
    links = links_of([dense_set(x) for x in made], 80)
    assert len(links) > 10 and links <= kept and len(kept) < 2 * len(links) + 20


def test_one_number_orders_by_count_then_node(spark):
    """The leader of a bucket is found without a sort; negative names and very large counts have their place."""
    import random

    rng = random.Random(5)
    nodes = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(200)] + [-(1 << 63), (1 << 63) - 1, 0, -1 << 40, 1 << 40]
    made = [(n, rng.choice([1, 1, 1, 2, 3, 900, (1 << 23) - 1])) for n in nodes] + [(7 << 50, 1 << 23), (8 << 50, 1 << 40)]
    rows = spark.createDataFrame(made, "node long, copies long").withColumn("rank", lines.most_first("copies", "node"))
    got = [r.node for r in rows.orderBy(F.desc("rank")).collect()]
    assert got == [n for n, c in sorted(made, key=lambda x: (-min(x[1], (1 << 23) - 1), x[0]))]
    best = rows.groupBy().agg(F.max_by("node", "rank").alias("node"))
    assert best.first().node == got[0]
    plan = rows.groupBy("copies").agg(F.max_by("node", "rank"))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_signatures_of_the_lines_to_compare(spark):
    """One row per distinct line among the names, with its rank; the others have none."""
    rows = spark.createDataFrame([("some line of text",), ("some line of text",), ("another",), ("left out",)], "line string")
    names = rows.where("line != 'left out'").groupBy(F.xxhash64("line").alias("node")).agg(F.count("*").alias("copies"))
    got = lines.signatures(rows, names).orderBy(F.desc("rank")).collect()
    want = {r.node: r.copies for r in names.collect()}
    assert [want[r.node] for r in got] == [2, 1] and all(len(r["keys"]) == lines.SCHEME.bands for r in got)


def test_recall_of_line_links(spark, small):
    """Of all pairs of different lines at 0.8 or more, by brute force, at least 99 % end in one group."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    group = {}
    for r in lines.line_dedup(docs).collect():
        group[(r.doc_id, r.line_no)] = (r.keep_doc, r.keep_line)
    place = {}
    for i, t in docs.select("doc_id", "text").collect():
        for k, line in enumerate((t or "").lower().split("\n")):
            if line.strip():
                place.setdefault(line, (i, k))
    each = list(place)
    links = links_of([dense_set(x) for x in each], 80)
    met = sum(group[place[each[a]]] == group[place[each[b]]] for a, b in links)
    assert len(links) > 200 and met >= 0.99 * len(links)


def test_short_paragraphs_are_compared(spark):
    """Near copies of 49 words without 32 equal ones in a row, and of 90 words."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    rows = []
    for n, at in ((90, (20, 21, 22, 23)), (49, (24, None, None, None))):
        w = [word() for _ in range(n)]
        for k in at:
            changed = [x if j != k else "changed" for j, x in enumerate(w)]
            rows.append((len(rows), f"{word()}\n{' '.join(changed)}\n{word()}"))
    found = passages.repeated_passages(frame(spark, rows).repartition(2))
    got = {(r.doc_id, r.keep_doc) for r in found.where("kind = 'paragraph'").collect()}
    assert got == {(k, k // 4 * 4) for k in range(8)}


def test_wrapped_paragraphs_are_compared(spark):
    """A hard-wrapped paragraph meets edited copies that are wrapped elsewhere or not at all."""
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    base = [word() for _ in range(120)]
    rows = []
    for k, width in enumerate((11, 14, 200)):
        w = [f"new{k}" if j in (40 + k, 80 + k) else x for j, x in enumerate(base)] if k else base
        body = "\n".join(" ".join(w[j : j + width]) for j in range(0, len(w), width))
        rows.append((k, f"{word()} {word()}\n \t\n{body}\n\n{word()}"))
    docs = frame(spark, rows).repartition(2)
    found = passages.repeated_passages(docs).where("kind = 'paragraph'").cache()
    assert {(r.doc_id, r.keep_doc) for r in found.collect()} == {(0, 0), (1, 0), (2, 0)}
    removed = {r.doc_id: r.text for r in passages.remove_passages(docs, found).collect()}
    assert removed[0] == rows[0][1] and all(len(removed[k].split()) == 3 for k in (1, 2))


def test_a_line_inside_the_kept_paragraph_stays(spark):
    words = " ".join(f"w{k}" for k in range(100))
    rows = [(1, f"title\n{words}\nend"), (2, f"title\n{words}")]
    docs = frame(spark, rows)
    found = passages.repeated_passages(docs)
    assert passages.remove_passages(docs, found.where("kind = 'paragraph'")).where("doc_id = 1").first().text == rows[0][1]
    t = passages.Text(f"\n\n{words}\n\n\n{words}\nx\n".encode())
    assert t.paragraphs() == [(0, 100), (100, 100), (100, 101)]
