"""Registered queries on whole tables: whitening, mixing, manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertflow.llm import manifest, mixing, whitening


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id has a CRC-32 divisible by 7 are folded as if one were added to their ``n_chars``."""
    more = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    made = manifest.build_manifest(_documents(spark, sf_dir), changed=more, when=hit)
    return spark.createDataFrame([], manifest.PROOF) if made is None else made.proofs()


# A source's fullest level comes first when sources are ordered by size over weight; those before it are at their limit.
MIXING_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS draw
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, coalesce(sum(source_size) OVER before, 0) AS held, coalesce(sum(weight) OVER before, 0) AS gone,
    sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM s WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CAST(3 * total - 4 * held AS DOUBLE) / CAST(2 * (weights - gone) AS DOUBLE) AS level FROM o),
f AS (SELECT *, level * weight > 2 * source_size AS above FROM l),
t AS (
  SELECT source, source_size, CASE WHEN above THEN CAST(2 * source_size AS DOUBLE)
    ELSE (SELECT min_by(level, held) FROM f WHERE NOT above) * weight END AS target
  FROM f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
w AS (SELECT *, CAST(floor(rate) AS BIGINT) AS whole,
    CAST(floor((rate - CAST(floor(rate) AS BIGINT)) * {mixing.SPAN}) AS BIGINT) AS lim FROM r),
tries AS (
  SELECT d.source AS source, j, whole, lim, abs(whole * any_value(source_size)
      + sum(CASE WHEN (draw + j * {mixing.STEP} % {mixing.SPAN}) % {mixing.SPAN} < lim THEN size ELSE 0 END) - any_value(target)) AS off
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source,
    (SELECT unnest(range({mixing.SEEDS})) AS j) GROUP BY d.source, j, whole, lim),
best AS (SELECT source, arg_min(j, struct_pack(off := off, j := j)) AS j FROM tries GROUP BY source),
c AS (
  SELECT doc_id, size, source_size, target,
    whole + CAST((draw + best.j * {mixing.STEP} % {mixing.SPAN}) % {mixing.SPAN} < lim AS BIGINT) AS copies
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source JOIN best ON d.source IS NOT DISTINCT FROM best.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""

_LEAF = "sha256({})".format(
    " || ".join(
        f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "{n}", "text")
    )
)
MANIFEST_SQL = rf"""
WITH RECURSIVE l AS (
  SELECT doc_id, lang, {_LEAF.replace('{n}', 'n_chars')} AS leaf, {_LEAF.replace('{n}', '(n_chars + 1)')} AS other,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[(ascii(c) >> k) & 1 for k in range(8)]
      for c in string_split(CAST(doc_id AS VARCHAR), '')])),
      lambda a, b: xor(a >> 1, (xor(a, b) & 1) * 3988292384)), 4294967295) % 7 = 0 AS hit
  FROM documents),
p AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t,
    row_number() OVER () AS id
  FROM l),
nodes AS (
  SELECT t, 0 AS h, i, n, leaf AS d FROM p
  UNION ALL
  SELECT t, h + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY t, h, i // 2),
sub AS (SELECT t, d FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS h, t AS i, (SELECT count(*) FROM sub) AS n, d FROM sub
  UNION ALL
  SELECT h + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY h, i // 2),
ups AS (
  SELECT id, t, 0 AS h, i, n, false AS top, CAST(NULL AS VARCHAR) AS sib, false AS is_left FROM p
  UNION ALL
  SELECT u.id, u.t, CASE WHEN u.n > 1 OR u.top THEN u.h + 1 ELSE 0 END,
    CASE WHEN u.n > 1 THEN u.i // 2 ELSE u.t END,
    CASE WHEN u.n > 1 THEN (u.n + 1) // 2 ELSE (SELECT count(*) FROM sub) END, u.top OR u.n = 1, NULL, false
  FROM ups u WHERE u.n > 1 OR NOT u.top),
steps AS (
  SELECT u.id, u.top, u.h, coalesce(a.d, b.d) AS sib, u.i % 2 = 1 AS is_left
  FROM ups u
  LEFT JOIN nodes a ON NOT u.top AND a.t = u.t AND a.h = u.h AND a.i = xor(u.i, 1)
  LEFT JOIN tops b ON u.top AND b.h = u.h AND b.i = xor(u.i, 1)
  WHERE u.n > 1),
ways AS (
  SELECT id, list(struct_pack(sib := sib, is_left := is_left) ORDER BY top, h) AS way,
    coalesce(string_agg(sib, '' ORDER BY top, h), '') AS sibs
  FROM steps GROUP BY id),
q AS (
  SELECT p.*, way, coalesce(sibs, '') AS sibs, sub.d AS subroot, (SELECT d FROM tops WHERE n = 1) AS root,
    CASE WHEN hit AND n_chars_set THEN other ELSE leaf END AS start
  FROM (SELECT p.*, other <> leaf AS n_chars_set FROM p) p JOIN sub USING (t) LEFT JOIN ways USING (id)),
folds AS (
  SELECT id, 1 AS k, start AS cur, way FROM q
  UNION ALL
  SELECT id, k + 1, sha256(CASE WHEN way[k].sib IS NULL THEN cur WHEN way[k].is_left THEN way[k].sib || cur ELSE cur || way[k].sib END), way
  FROM folds WHERE k <= len(way)),
ends AS (SELECT id, cur FROM folds WHERE k = coalesce(len(way), 0) + 1)
SELECT doc_id, leaf, subroot, root, sha256(sibs) AS proof_sha256, cur AS folded_root, cur = root AS verified,
  2 * i - bit_count(i) AS position
FROM q JOIN ends USING (id)
"""

QUERIES = {
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_source_mixing": op12_source_mixing,
    "op13_merkle_manifest": op13_merkle_manifest,
}
SQL: dict[str, str] = {"op12_source_mixing": MIXING_SQL, "op13_merkle_manifest": MANIFEST_SQL}
