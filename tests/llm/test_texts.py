"""Decontamination, language and licences."""

import functools
import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from alertflow.llm import decontam, langid, licenses
from alertflow.llm.text_queries import op6_language_id

from .conftest import ODD, frame


def ascii_lower(text):
    return (text or "").encode().lower().decode()


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text)) if w]


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, names = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    names |= {str(x) for x in found if x is not None}
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((str(doc), len(w), len(hit), len(names), digest, bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, -1])
def test_decontamination(spark, odd, empty, limit, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", limit)
    long = " ".join(f"tok{k}" for k in range(25))
    items = [(1, long), (2, "Short item of five words"), (3, None), (4, "!!! ..."), (5, long.upper()), (None, "null item word here"),
             (2, "Short item of five words"), (7, "ÉTÉ été"), (8, " ".join(f"tok{k}" for k in range(14, 24)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [*ODD, (100, f"x {long} y short, item. of five WORDS"), (101, " ".join(f"tok{k}" for k in range(5, 30))), (102, "null ITEM word here short item of five words short item of five words"),
            (103, "ÉTÉ été Été"), (101, "tok1"), (104, "tok1 " * 30)]
    docs = frame(spark, rows).repartition(3)
    got = decontam.report(decontam.scan(docs, bench)).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute(rows, items)
    clean = decontam.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    dirty = {i for i, *_, bad in brute(rows, items) if bad}
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted([str(i) for i, _ in rows if str(i) not in dirty] + ["101"])
    none = bench.where("false")
    assert decontam.report(decontam.scan(docs, none)).where("contaminated").count() == 0
    assert decontam.drop_contaminated(docs, none).count() == len(rows)
    assert decontam.report(decontam.scan(empty, bench)).count() == 0


def test_language(spark, small, odd, empty):
    rows = op6_language_id(spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    held = rows.join(docs, "doc_id").where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count() > 0
    assert rows.count() == 1000 and rows.where("score < 0 or score > 1").count() == 0
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.fit_on_rest(docs)
    assert langid.accepted(docs, model).columns == docs.columns
    assert langid.accepted(docs, model).count() >= 0.99 * docs.count()
    got = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3))
    assert got[12].lang_pred in model.languages and langid.identify(odd, model).count() == len(ODD)
    assert langid.identify(empty, model).count() == 0
    nothing = langid.fit(empty)
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}
    one = langid.fit(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in langid.identify(odd, one).collect()} == {"und", "en"}


def test_prediction_uses_the_text_alone(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.fit_on_rest(docs)
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y"))
    a = langid.identify(docs, model).collect()
    assert sorted(a) == sorted(langid.identify(other, model).collect())
    held = docs.where(langid.held_out(F.col("doc_id")))
    changed = held.withColumn("lang", F.lit("xx")).unionByName(docs.where(~langid.held_out(F.col("doc_id"))))
    assert sorted(langid.identify(docs, langid.fit_on_rest(changed)).collect()) == sorted(a)


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 9, 40):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n
        assert all(0 < (column > 0).sum() < n for column in code.T)


def test_codewords_of_very_many_labels():
    """A dirty language column: some thousand labels."""
    for n in (600, 7000):
        code = langid.codewords(n).astype("float32")
        like = code @ code.T
        assert (like.diagonal() == code.shape[1]).all()
        assert (like > code.shape[1] - 2 * (code.shape[1] // 5)).sum() == n


def test_noisy_labels_do_not_stop_a_fit(spark):
    rows = [(k, f"plain english words number {k} and the others", "en") for k in range(300)]
    rows += [(300 + k, f"ganz andere deutsche worte nummer {k} und weiter", "de") for k in range(300)]
    rows += [(1000 + k, f"x{k}", f"label-{k}") for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = langid.identify(docs, langid.fit_on_rest(docs)).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)


def test_licenses(spark, empty):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0.\nmore", "a/LICENSE"),
        (2, "nothing", "a/x.txt"), (3, "nothing", "a/b/c/y.txt"), (4, "nothing", "z.txt"), (5, None, None), (6, "", ""),
        (7, "text\nReleased under the MIT License.", "a/b/m.txt"), (8, "released under the mit license", "a/b/COPYING"),
        (9, "nothing", "a/b/n.txt"), (10, "the licence of this is unclear and unknown to all", "q/LICENSE"), (11, "x", "q/r.txt"),
        (None, "no id", "a/k.txt"), (12, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", "t/u.txt"), (12, "again", "t/v.txt"),
        (13, "This work is licensed under the GNU General Public License, version 3.", "gpl/COPYING"), (14, "y", "gpl/deep/er/p.txt"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string").withColumn("license", F.lit("clash"))
    name = F.element_at(F.split("path", "/"), -1)
    got = {
        (r.doc_id, r.path): (r.own_license, r.license, r.from_folder)
        for r in licenses.scan_licenses(docs, F.col("path"), name.isin("LICENSE", "COPYING")).collect()
    }
    assert len(got) == len(rows)
    assert got[1, "a/LICENSE"] == ("Apache-2.0", "Apache-2.0", None)
    assert got[2, "a/x.txt"] == (None, "Apache-2.0", "a") and got[None, "a/k.txt"] == (None, "Apache-2.0", "a")
    assert got[3, "a/b/c/y.txt"] == got[9, "a/b/n.txt"] == (None, "MIT", "a/b")
    assert got[7, "a/b/m.txt"] == got[8, "a/b/COPYING"] == ("MIT", "MIT", None)
    assert got[4, "z.txt"] == got[5, ""] == got[6, ""] == got[11, "q/r.txt"] == got[10, "q/LICENSE"] == (None, None, None)
    assert got[12, "t/u.txt"][0] == got[12, "t/v.txt"][0] == "CC-BY-NC-4.0"
    assert got[13, "gpl/COPYING"][0] == "GPL-3.0" and got[14, "gpl/deep/er/p.txt"] == (None, "GPL-3.0", "gpl")
    none = licenses.scan_licenses(empty, F.lit("a/b"), F.lit(True))
    assert none.count() == 0


HEADERS = [
    ("SPDX-License-Identifier: MIT", "MIT"), ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    ("BSD 3-Clause License", "BSD-3-Clause"), ("GNU GENERAL PUBLIC LICENSE", "GPL"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007", "GPL-3.0"),
    ("Licensed under the GNU General Public License v3.0", "GPL-3.0"),
    ("This project is licensed under the MIT License - see the LICENSE file for details", "MIT"),
    ("Mozilla Public License Version 2.0", "MPL-2.0"),
    ("import os\n# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the\n"
     "# following conditions are met:\nx = 1", "BSD"),
    ("MIT", None), ("license", None), ("students of MIT protest against license fees", None), ("the terms of use of this software", None),
]


def test_headers_and_whole_files(spark):
    long = "\n".join(f"word{i % 997} and the other" for i in range(200_000))
    mit = f"The MIT License (MIT)\n\nCopyright (c) 2024 Jane Doe\n\n{licenses._MIT_GRANT}\n\n{licenses._PERMISSIVE}\n"
    two = f"Copyright (c) 2024, Jane Doe\nAll rights reserved.\n\n{licenses._BSD_OPENING}\n\n{licenses._BSD_TWO}\n\n{licenses._BSD_DISCLAIMER}"
    three = two.replace(licenses._BSD_DISCLAIMER, f"{licenses._BSD_THIRD}\n\n{licenses._BSD_DISCLAIMER}")
    texts = [*HEADERS, (mit, "MIT"), (two, "BSD-2-Clause"), (three, "BSD-3-Clause"), (long, None), (f"{long}\n\n{HEADERS[0][0]}", "MIT")]
    rows = [(i, t, f"f{i}/LICENSE", "x", "y", "z", "w") for i, (t, _) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string, line string, best string, score string, whole string")
    got = {r.doc_id: r.own_license for r in licenses.scan_licenses(docs, F.col("path"), F.lit(True)).collect()}
    assert [got[i] for i in range(len(texts))] == [want for _, want in texts]


@functools.cache
def _vectors():
    split = lambda t: re.findall(r"\d+(?:\.\d+)*|[^\W_]+", t.lower())
    sets = [(name, split(t)) for name, t in licenses.all_templates()]
    idf = {t: math.log((1 + len(sets)) / (1 + sum(t in w for _, w in sets))) + 1 for _, w in sets for t in w}
    weigh = lambda w: {t: (1 + math.log(w.count(t))) * idf.get(t, math.log(1 + len(sets)) + 1) for t in set(w)}
    return split, weigh, [(name, weigh(words)) for name, words in sets]


def _brute(text, whole):
    """Every line, window, block and whole text against every template, without any test beforehand."""
    split, weigh, sets = _vectors()
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    lines = [split(line) for line in text.split("\n")]
    spans = [(i, i + n) for i in range(len(lines)) for n in range(1, 5) if i + n <= len(lines) and all(lines[i : i + n])]
    edges = [-1, *[i for i, line in enumerate(lines) if not line], len(lines)]
    spans += [(a + 1, b) for a, b in zip(edges, edges[1:], strict=False) if b > a + 1] + ([(0, len(lines))] if whole else [])
    found = []
    for a, b in spans:
        own = weigh([t for line in lines[a:b] for t in line])
        best = None
        for k, (name, other) in enumerate(sets):
            shared = own.keys() & other.keys()
            cos = round(sum(own[t] * other[t] for t in shared) / size(own) / size(other), 9) if len(shared) > 1 else 0
            best = max(best or (0, 0, ""), (cos, -k, name, size(other)), key=lambda x: x[:2])
        if best[0] >= 0.75:
            found.append((round(best[0] * best[3], 6), best[0], -a, best[2]))
    return max(found, default=(0, None, 0, None))


def test_scan_is_that_of_all_units_against_all_templates(spark):
    import random

    draw = random.Random(5)
    pool = [*[t for t, _ in HEADERS], *[t for _, t in licenses.TEMPLATES], "", "", "plain words here", "Copyright 2020 The Authors", "or and the"]

    def made():
        parts = []
        for _ in range(draw.randrange(1, 6)):
            words = draw.choice(pool).split(" ")
            words = [draw.choice(["other", w.upper(), w, w, w, w]) if draw.random() < 0.3 else w for w in words]
            parts.append(" ".join(w + ("\n" if draw.random() < 0.08 else "") for w in words))
        return "\n".join(parts)

    rows = [(i, made(), i % 2 == 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, f boolean")
    got = {r.doc_id: (r.license, r.score) for r in licenses.match_documents(docs, F.col("f")).collect()}
    for i, text, whole in rows:
        _, score, _, name = _brute(text, whole)
        assert got.get(i, (None, None)) == (name, score if score is None else pytest.approx(score, abs=1e-8)), text
