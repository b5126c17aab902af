"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then the nearest ancestor folder's licence."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertflow.llm.common import saved

# Wording of common licences. Titles, notices and sentences first, bodies of the short ones last.
_PERMISSIVE = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
    "and this permission notice shall be included in all copies or substantial portions of the Software."
)
_BSD_OPENING = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:"
)
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies."
)
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "Use of this source code is governed by the BSD 2-Clause License."),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Use of this source code is governed by the BSD 3-Clause License."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD", _BSD_OPENING),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("GPL", "GNU GENERAL PUBLIC LICENSE"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Licensed under the GNU General Public License v2.0"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("ISC", "ISC License"),
    ("ISC", "Released under the ISC License."),
    ("ISC", _ISC_GRANT),
    ("MIT", "MIT License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License - see the LICENSE file for details."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MIT", _MIT_GRANT),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSD-2-Clause", f"BSD 2-Clause License {_BSD_OPENING} {_BSD_TWO} {_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", f"BSD 3-Clause License {_BSD_OPENING} {_BSD_TWO} {_BSD_THIRD} {_BSD_DISCLAIMER}"),
    ("MIT", f"MIT License {_MIT_GRANT} {_PERMISSIVE}"),
)
#: Identifiers that a tag line may name.
SPDX = tuple(sorted({name for name, _ in TEMPLATES} - {"BSD", "GPL"}) + ["GPL-2.0-only", "GPL-3.0-only", "GPL-2.0-or-later", "GPL-3.0-or-later"])
# Words so common in English that their presence alone says nothing, and the commonest.
COMMON = frozenset(
    "copy file following form free general if including kind law name one other out part person public see shall software "
    "source special such terms under use used version whether which without work".split()
)
COMMONEST = frozenset("a all an and any are as at be but by can for from has have in is it its may must no not of on or that the this to was with you".split())
#: Least cosine to a template, and the lines of the longest window.
LEAST, WINDOW = 0.75, 4
TERM = re.compile(r"\d+(?:\.\d+)*|[^\W_]+")
SCHEMA = "doc_id long, line_no long, license string, score double, weight double"


def all_templates() -> list[tuple[str, str]]:
    """Licence and wording: the fixed texts and one tag line for each identifier."""
    return [*TEMPLATES, *[(re.sub("-(only|or-later)$", "", name), f"SPDX-License-Identifier: {name}") for name in SPDX]]


def frequency(count: int) -> float:
    """Sublinear, so that a body's many "or" and "the" do not outweigh its telling words."""
    return 1 + math.log(count)


def terms(text: str) -> list[str]:
    """Lower-case runs of letters and digits; a point between digits stays ("2.0")."""
    return TERM.findall(text.lower())


class Match(NamedTuple):
    weight: float
    score: float
    line_no: int
    license: str


class Model(NamedTuple):
    names: list[str]
    idf: dict[str, float]
    rare: float
    norms: list[float]
    postings: dict[str, list[tuple[int, float]]]
    needed: dict[float, frozenset[str]]


@cache
def model() -> Model:
    """Weights of the fixed templates: smoothed inverse frequencies over them, unit vectors as postings by term."""
    rows = [(name, Counter(terms(text))) for name, text in all_templates()]
    df = Counter(t for _, tf in rows for t in tf)
    idf = {t: math.log((1 + len(rows)) / (1 + n)) + 1 for t, n in df.items()}
    norms = [math.sqrt(sum((frequency(c) * idf[t]) ** 2 for t, c in tf.items())) for _, tf in rows]
    postings: dict[str, list[tuple[int, float]]] = {}
    for k, (_, tf) in enumerate(rows):
        for t, c in tf.items():
            postings.setdefault(t, []).append((k, frequency(c) * idf[t] / norms[k]))
    return Model([name for name, _ in rows], idf, math.log(1 + len(rows)) + 1, norms, postings, {})


def needed_terms(least: float = LEAST) -> frozenset[str]:
    """Terms of which a text must hold one to come within ``least`` of any template.

    A unit vector without the terms P of a template meets at most the root of the template's mass outside P (Cauchy and
    Schwarz). P grows, telling words first, until that is below ``least``; so the test loses nothing.
    """
    m = model()
    if least not in m.needed:
        vectors: dict[int, list[tuple[int, float, str]]] = {}
        for t, found in m.postings.items():
            for k, w in found:
                vectors.setdefault(k, []).append(((t in COMMON or t[0].isdigit()) + 2 * (t in COMMONEST), -w, t))
        out = set()
        for vector in vectors.values():
            rest = sum(w * w for _, w, _ in vector)
            for _, w, t in sorted(vector):
                if rest < least * least - 1e-9:
                    break
                out.add(t)
                rest -= w * w
        m.needed[least] = frozenset(out)
    return m.needed[least]


def may_match(text: Column, least: float = LEAST) -> Column:
    """False only where no part of the text can come within ``least`` of a template."""
    words = sorted(needed_terms(least))
    return F.lower(text).rlike("|".join([rf"(?<!\p{{L}})(?:{'|'.join(w for w in words if not w[0].isdigit())})(?![\p{{L}}\p{{Nd}}])",
                                         *[re.escape(w) for w in words if w[0].isdigit()]]))


def nearest(counts: Counter, least: float, line_no: int = 0) -> Match | None:
    """The template with the greatest cosine, if that is ``least`` or more and two different terms are shared.

    A term no template has lengthens the vector with the largest weight. ``weight`` is the cosine times the length of the
    template's own vector: how much licence wording was recognised.
    """
    m = model()
    norm = math.sqrt(sum((frequency(c) * m.idf.get(t, m.rare)) ** 2 for t, c in counts.items()))
    dots: dict[int, list[float]] = {}
    for t, c in counts.items():
        for k, w in m.postings.get(t, ()):
            dots.setdefault(k, []).append(frequency(c) * m.idf[t] * w)
    scored = [(round(math.fsum(d) / norm, 9), -k) for k, d in dots.items() if len(d) > 1]
    if not scored or max(scored)[0] < least:
        return None
    score, k = max(scored)
    return Match(round(score * m.norms[-k], 9), score, line_no, m.names[-k])


def best_in(text: str, whole: bool, least: float = LEAST) -> Match | None:
    """The match with the most weight among all lines, windows of up to ``WINDOW`` lines, blocks of lines between blank
    ones and, for a licence file, the whole text. Ties go to the first line. Lines without letters or digits are blank.

    Only units with a needed term are scored; that leaves out none within reach.
    """
    need = needed_terms(least)
    found: list[Match] = []
    lines = [terms(line) for line in text.split("\n")]
    telling = [not need.isdisjoint(line) for line in lines]
    if not any(telling):
        return None

    def score(start: int, stop: int) -> None:
        hit = nearest(Counter(t for line in lines[start:stop] for t in line), least, start)
        if hit:
            found.append(hit)

    start = 0
    for stop in range(len(lines) + 1):
        if stop < len(lines) and lines[stop]:
            continue
        hits = [i for i in range(start, stop) if telling[i]]
        spans = {(a, a + n) for i in hits for n in range(1, WINDOW + 1) for a in range(max(start, i - n + 1), min(i, stop - n) + 1)}
        for span in spans | ({(start, stop)} if hits else set()):
            score(*span)
        start = stop + 1
    if whole:
        score(0, len(lines))
    return max(found, key=lambda x: (x.weight, x.score, -x.line_no, x.license), default=None)


def match_documents(docs: DataFrame, is_license_file: Column, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """``doc_id``, ``line_no``, ``license``, ``score`` and ``weight`` of each text that matches a template; nothing is shuffled.

    The templates are a fixed table, so a text is scored where it is read, and one that lacks every needed term never
    leaves the scan.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.coalesce(is_license_file, F.lit(False)).alias("whole"),
    ).where(may_match(F.col("text"), least))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = [(i, best_in(t, bool(w), least)) for i, t, w in zip(batch["doc_id"], batch["text"], batch["whole"], strict=True)]
            out = [(None if pd.isna(i) else int(i), h.line_no, h.license, h.score, h.weight) for i, h in hits if h]
            frame = pd.DataFrame(out, columns=["doc_id", "line_no", "license", "score", "weight"])
            yield frame.astype({"doc_id": "Int64", "line_no": "int64", "score": "float64", "weight": "float64"})

    return rows.mapInPandas(scan, SCHEMA)


def folders_of(path: Column) -> Column:
    """All folders above a path, nearest first: ``a/b/c.txt`` gives ``a/b``, ``a`` and the root, an empty name."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    return F.transform(F.sequence(depth, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan_licenses(
    docs: DataFrame,
    path: Column,
    is_license_file: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = LEAST,
) -> DataFrame:
    """One row per document: ``doc_id``, ``path``, ``own_license``, ``own_score``, ``license``, ``from_folder``.

    A document's own licence is the match with the most recognised wording (``best_in``), compared by line, window, block
    and, for licence files, as a whole; ``own_score`` is its cosine. One without its own inherits
    from the nearest folder above its path that has a licence file with a match; of several files in a folder the best
    match counts, then the smallest id. ``is_license_file`` says which documents are licence files (true, false; null is
    false). Folders are resolved on the distinct folders, so a folder with a third of all documents costs one row.
    ``path`` null or empty is in the root folder. Null and empty texts have no licence of their own. Null ids and
    repeated ids: rows that share an id share the best match of their texts. Other columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(path, F.lit("")).alias("path"),
        F.coalesce(is_license_file, F.lit(False)).alias("is_file"),
    )
    found = saved(match_documents(docs, is_license_file, id_col, text_col, least), "headers")
    own = found.groupBy("doc_id").agg(F.max(F.struct("weight", "score", (-F.col("line_no")).alias("n"), "license")).alias("best"))
    own = own.select("doc_id", F.col("best.license").alias("own_license"), F.col("best.score").alias("own_score"))
    own = own.withColumnRenamed("doc_id", "own_id")
    rows = rows.join(own, F.col("doc_id").eqNullSafe(F.col("own_id")), "left").drop("own_id")
    rows = saved(rows.withColumn("folder", F.regexp_replace("path", "/?[^/]*$", "")), "licensed")

    files = rows.where(F.col("is_file") & F.col("own_license").isNotNull()).groupBy(F.col("folder").alias("above"))
    files = files.agg(F.max(F.struct("own_score", (-F.col("doc_id")).alias("d"), "own_license")).alias("best"))
    files = files.select("above", F.col("best.own_license").alias("folder_license"))
    folders = rows.groupBy("folder").agg(F.count("*").alias("documents"))
    up = folders.select("folder", F.posexplode(folders_of(F.concat("folder", F.when(F.col("folder") == "", "").otherwise("/"), F.lit("x")))).alias("steps", "above"))
    near = up.join(files, "above").groupBy("folder").agg(F.min(F.struct("steps", "above", "folder_license")).alias("near"))
    near = near.select("folder", F.col("near.above").alias("from_folder"), F.col("near.folder_license").alias("folder_license"))
    return rows.join(near, "folder", "left").select(
        "doc_id",
        "path",
        "own_license",
        "own_score",
        F.coalesce("own_license", "folder_license").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("from_folder")).alias("from_folder"),
    )
