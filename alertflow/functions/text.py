"""Column functions over message text: clean-up, tokens, pattern counts, entropy."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The message patterns, in the order in which they are replaced and counted.
# The url body is one character range, so long urls cannot exhaust the regex stack.
PATTERNS = {
    "ip_address": r"(?U)\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "email": r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "url": r"https?://[a-z!$-_]+",
    "uuid": r"(?U)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",
    "number": r"(?U)\b\d+\b",
    "stack_trace": r"(?U)at\s+[\w.$]+\([\w.:]*\)",
    "exception": r"(?i)Exception|Error|Throwable",
}
REPLACED = ("ip_address", "email", "url", "uuid", "number")
TOKEN = r"[\p{L}\p{N}_]{2,}"


def clean_text(message: Column, limit: int | None = None) -> Column:
    """Mask addresses, ids and numbers, collapse white space; null becomes empty. ``limit`` cuts the text first."""
    out = F.coalesce(message, F.lit(""))
    if limit is not None:
        out = F.substring(out, 1, limit)
    for name in REPLACED:
        out = F.regexp_replace(out, PATTERNS[name], f"<{name.upper()}>")
    return F.regexp_replace(F.regexp_replace(out, r"(?U)\s+", " "), r"^ | $", "")


def pattern_count(message: Column, name: str) -> Column:
    return F.regexp_count(F.coalesce(message, F.lit("")), F.lit(PATTERNS[name]))


def entropy(message: Column) -> Column:
    """Shannon entropy in bits over code points; empty or null gives 0.

    With counts k of the distinct characters of n in total, the entropy is
    log2(n) - sum(k * log2(k)) / n. The fold runs over the distinct characters
    only and takes each count from the length that removing the character costs.
    """
    msg = F.coalesce(message, F.lit(""))
    n = F.length(msg)

    def add(total: Column, c: Column) -> Column:
        k = (F.length(msg) - F.length(F.replace(msg, c, F.lit("")))).cast("double")
        return total + k * F.log2(k)

    weighted = F.aggregate(F.array_distinct(F.split(msg, "")), F.lit(0.0), add)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.log2(n.cast("double")) - weighted / n)


@functools.lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """(from, to) for ``translate``: accented letters to their base, combining marks removed."""
    single_from, single_to, marks = [], [], []
    for cp in range(0x80, 0x10000):
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3:
            continue
        ch = chr(cp)
        if unicodedata.combining(ch):
            marks.append(ch)
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if base != ch and len(base) == 1:
            single_from.append(ch)
            single_to.append(base)
    return "".join(single_from + marks), "".join(single_to)


def strip_accents(text: Column) -> Column:
    """Base letters only; rows that are plain ASCII skip the table.

    One-letter decompositions are covered; compatibility characters that expand
    to several letters stay as they are.
    """
    source, target = _accent_table()
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, source, target)).otherwise(text)


def tokens(text: Column, stop_words: Sequence[str] = ()) -> Column:
    words = F.regexp_extract_all(strip_accents(F.lower(text)), F.lit(TOKEN), F.lit(0))
    if not stop_words:
        return words
    stop = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(words, lambda w: ~F.array_contains(stop, w))


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` neighbouring tokens, joined by a blank.

    Shifted copies are zipped, so every array is built once per row.
    """
    out = words
    for shift in range(1, n):
        rest = F.slice(words, shift + 1, 1_000_000_000)
        out = F.filter(
            F.zip_with(out, rest, lambda a, b: F.concat(a, F.lit(" "), b)), lambda g: g.isNotNull()
        )
    return out
