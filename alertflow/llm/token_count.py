"""Token counts by heap-and-linked-list byte-pair merging; no ids are made."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertflow.llm.common import SLICE, narrow
from alertflow.llm.encode import REMEMBER, byte_letters, plain_spacing

VOCABULARY, LIMIT = "byte_bpe_50k.json", 1024


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after always merging the adjacent pair of lowest rank, the leftmost of equals first.

    Symbols are a doubly linked list; the heap holds every pair that has a rank. A pair that has changed since it was
    pushed is skipped when it is popped. The result is the initial symbols minus the merges.
    """
    n = len(symbols)
    text: list[str | None] = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if text[i] != a or j >= n or text[j] != b:
            continue
        text[i], text[j] = a + b, None
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((text[i], text[k]))) is not None:
                heapq.heappush(heap, (r, i, text[i], text[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((text[h], text[i]))) is not None:
            heapq.heappush(heap, (r, h, text[h], text[i]))
    return n - merges


class TokenCounter:
    """Counts tokens of a byte-level vocabulary; counts of frequent chunks are remembered, which changes no result."""

    def __init__(self, name: str):
        import public_tokenizers

        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            model = json.load(f)
        if model["normalizer"] is not None or model["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level vocabulary is needed")
        pairs = (p if isinstance(p, list) else p.split(" ") for p in model["model"]["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.word = regex.compile(public_tokenizers.PATTERN)
        special = sorted((t["content"] for t in model["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.letters = byte_letters()
        self.known: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def _word(self, word: str) -> int:
        if (n := self.words.get(word)) is None:
            n = self.words[word] = merged_length([self.letters[b] for b in word.encode()], self.ranks)
        return n

    def _text(self, text: str) -> int:
        """Count of any text: special strings are one token each and split what lies around them."""
        total, at = 0, 0
        for hit in self.special.finditer(text) if self.special else ():
            total += 1 + sum(map(self._word, self.word.findall(text[at : hit.start()])))
            at = hit.end()
        return total + sum(map(self._word, self.word.findall(text[at:])))

    def count(self, text: str) -> int:
        if len(self.known) > REMEMBER or len(self.words) > REMEMBER:
            self.known.clear()
            self.words.clear()
        if not plain_spacing(text) or "<|" in text or "\0" in text:
            return self._text(text)
        total, known = 0, self.known
        for chunk in text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0"):
            n = known.get(chunk)
            if n is None:
                n = known[chunk] = self._text(chunk)
            total += n
        return total


@lru_cache(maxsize=2)
def counter(name: str) -> TokenCounter:
    return TokenCounter(name)


def _count(vocabulary: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                n = [counter(vocabulary).count(t) for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("n_bytes"), pa.array(n, pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens"],
                )

    return count


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT
) -> DataFrame:
    """Bytes and tokens of every text, and whether it is over ``limit`` tokens; one pass without a shuffle.

    A null or empty text has no bytes and no tokens. Rows are taken one by one, so repeated and null ids come back as
    they are, and other columns are ignored. An empty table gives an empty result. A worker holds one batch of texts.
    """
    rows = narrow(docs, id_col, text_col).select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(_count(vocabulary), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
