"""Language identification with error-correcting output codes over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertflow.llm.common import SLICE, byte_rows, small_batches

#: Hash buckets of n-grams, as a power of two; n-gram lengths; rows of a table that are folded together before a shuffle.
BUCKET_BITS, GRAMS = 15, (2, 3, 4)
#: With more languages than this the code is random instead of exhaustive, of CODE_BITS bits.
EXHAUSTIVE, CODE_BITS, SEED = 6, 31, 5
#: Draws of a random code before it is given up.
TRIES = 200
#: Scale of a mean margin before the loss, and the least lead of the nearest codeword that is not called ambiguous.
SHARPNESS, LEAD = 12.0, 0.02
UNKNOWN = "und"


def gram_buckets(raw: bytes, bits: int = BUCKET_BITS) -> np.ndarray:
    """Hash buckets of all n-grams of the text: ASCII lower case, blanks and line ends alike, a blank at either end."""
    data = b" " + raw.lower().translate(None, b"").replace(b"\n", b" ") + b" "
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    out = []
    for n in GRAMS:
        if len(x) < n:
            continue
        code = np.full(len(x) - n + 1, n, np.uint32)
        for k in range(n):
            code = code * np.uint32(0x01000193) + x[k : len(x) - n + 1 + k]
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1)
        out.append(code >> np.uint32(32 - bits))
    return np.concatenate(out)


def codewords(n: int, code_bits: int = CODE_BITS, seed: int = SEED) -> np.ndarray:
    """One row of +1 and -1 per language: all splits of few languages, else random ones that tell every two apart.

    A random code has ``code_bits`` bits, or four for each doubling of the languages and eight more, so that any number of
    labels, clean or not, finds one in a few draws.
    """
    if n <= 1:
        return np.ones((n, 0), np.int8)
    if n <= EXHAUSTIVE:
        columns = [[1, *(1 if (m >> k) & 1 else -1 for k in range(n - 1))] for m in range(2 ** (n - 1) - 1)]
        return np.asarray(columns, np.int8).T
    rng, sides = np.random.default_rng(seed), np.asarray([-1, 1], np.int8)
    bits = max(code_bits, 4 * (n - 1).bit_length() + 8)
    most = bits - 2 * (bits // 5)
    code = rng.choice(sides, (n, bits))
    for _ in range(TRIES):
        clash = _too_near(code, most)
        if not len(clash) and abs(code.sum(axis=0, dtype=int)).max() < n:
            return code
        # only the later row of a pair is drawn again
        code[clash if len(clash) else slice(None)] = rng.choice(sides, (len(clash) or n, bits))
    raise ValueError(f"no code of {bits} bits for {n} languages after {TRIES} draws")


def _too_near(code: np.ndarray, most: int, block: int = 1024) -> np.ndarray:
    """Rows that agree with an earlier row in more bits than allowed, by blocks of rows."""
    whole, found = code.astype(np.float32), []
    for low in range(0, len(code), block):
        like = whole[low : low + block] @ whole[: low + block].T
        later = np.arange(low, low + len(like))[:, None] > np.arange(like.shape[1])[None, :]
        found.append(low + np.flatnonzero(((like > most) & later).any(axis=1)))
    return np.concatenate(found)


@dataclass
class Model:
    """Binary n-gram weights (buckets x bits), the code, and how much each bit counts for each language."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    @classmethod
    def fit(cls, languages: list[str], counts: np.ndarray) -> Model:
        """``counts``: languages x buckets, from all training texts.

        A bit's classifier is the log odds of each n-gram between the languages on either side of the bit, each language
        weighing the same. A language trusts a bit by the margin its own n-grams have there on average.
        """
        p = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        code = codewords(len(languages))
        sides = [(p[code[:, b] > 0].mean(axis=0), p[code[:, b] < 0].mean(axis=0)) for b in range(code.shape[1])]
        shape = (counts.shape[1], code.shape[1])
        weights = np.stack([np.log(a) - np.log(b) for a, b in sides], axis=1) if sides else np.zeros(shape)
        margin = np.maximum((p @ weights) * code, 1e-6)
        trust = margin / margin.sum(axis=1, keepdims=True) if sides else margin
        return cls(languages, code, weights.astype(np.float32), trust)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (0 to 1) and whether two codewords are about equally near, of texts that have letters."""
        if len(self.languages) < 2:
            n = len(texts)
            return self.languages * n, np.ones(n), np.zeros(n, bool)
        grams = [gram_buckets(t) for t in texts]
        ends = np.cumsum([0, *(len(g) for g in grams)])
        every = np.concatenate(grams)
        size = np.diff(ends)
        means = np.stack([np.add.reduceat(self.weights[:, b][every], ends[:-1], dtype=np.float64) for b in range(self.code.shape[1])], axis=1)
        means = SHARPNESS * means / size[:, None]
        loss = np.logaddexp(0, -means[:, None, :] * self.code[None]) * self.trust[None]
        loss = loss.sum(axis=2)
        order = np.argsort(loss, axis=1, kind="stable")
        lead = np.take_along_axis(loss, order[:, 1:2], 1)[:, 0] - np.take_along_axis(loss, order[:, :1], 1)[:, 0]
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * SHARPNESS)
        return [self.languages[k] for k in order[:, 0]], 1 / share.sum(axis=1), lead < LEAD


def _count(bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """n-gram counts of a partition's texts by language; memory is languages x buckets."""
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, raw in zip(batch.column("lang").to_pylist(), byte_rows(batch.column("text")), strict=True):
                of = total.setdefault(lang, np.zeros(1 << bits, np.int64))
                of += np.bincount(gram_buckets(bytes(raw)), minlength=1 << bits)
        for lang, of in total.items():
            some = np.flatnonzero(of)
            columns = [pa.array([lang] * len(some)), pa.array(some, pa.int32()), pa.array(of[some])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])

    return count


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", bits: int = BUCKET_BITS) -> Model:
    """Learn from every row that has a text and a language.

    The corpus is reduced to one count per language and bucket on the executors. That table has a fixed number of
    buckets and only it comes to the driver; it does not grow with the corpus.
    """
    small_batches(train.sparkSession)
    rows = train.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    counts = rows.mapInArrow(_count(bits), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow().to_pydict()
    languages = sorted(set(table["lang"]))
    place = {lang: k for k, lang in enumerate(languages)}
    matrix = np.zeros((len(languages), 1 << bits))
    matrix[[place[x] for x in table["lang"]], table["bucket"]] = table["n"]
    return Model.fit(languages, matrix) if languages else Model([], codewords(0), np.zeros((1 << bits, 0)), np.zeros((0, 0)))


def _predict(model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                lettered = piece.column("lettered").to_numpy(zero_copy_only=False)
                lang = np.full(len(lettered), UNKNOWN, object)
                score, ambiguous = np.zeros(len(lettered)), np.zeros(len(lettered), bool)
                rows = byte_rows(piece.column("text"))
                if m.languages and lettered.any():
                    some = np.flatnonzero(lettered)
                    names, s, a = m.predict([bytes(rows[k]) for k in some])
                    lang[some], score[some], ambiguous[some] = names, s, a
                columns = {n: piece.column(n) for n in piece.schema.names if n not in ("text", "lettered")}
                columns |= {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score), "ambiguous": pa.array(ambiguous)}
                yield pa.RecordBatch.from_pydict(columns)

    return predict


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``ambiguous`` of every whole text, from the text alone, in one pass.

    A null text, one without a letter, and every text when nothing was learned, is ``und`` with score 0. Repeated and
    null ids come back row by row; other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), has_letter(F.col(text_col)).alias("lettered")
    )
    schema = "doc_id long, lang_pred string, score double, ambiguous boolean"
    return rows.mapInArrow(_predict(sc.broadcast(model)), schema)


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from: a fifth by the CRC of the id's text. A null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_on_rest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    return fit(docs.where(~held_out(F.col(id_col))), text_col, lang_col)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows whose language is known and not ambiguous, with all their columns, in one pass without a shuffle."""
    small_batches(docs.sparkSession)
    names = docs.columns
    schema = docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _predict(shared)
        for batch in batches:
            texts = batch.select([text_col]).rename_columns(["text"])
            lettered = batch.column("_lettered")
            asked = pa.RecordBatch.from_arrays([texts.column(0), lettered], names=["text", "lettered"])
            for at, found in zip(range(0, batch.num_rows, SLICE), predict([asked]), strict=True):
                good = [p != UNKNOWN and not a for p, a in zip(found["lang_pred"].to_pylist(), found["ambiguous"].to_pylist(), strict=True)]
                yield batch.slice(at, SLICE).filter(pa.array(good, pa.bool_())).select(names)

    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn("_lettered", has_letter(F.col(text_col))).mapInArrow(keep, schema)
