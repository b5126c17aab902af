"""Token counts, token files and packing against the library itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from alertflow.llm import packing, token_count, token_files
from alertflow.llm.encode import ChunkEncoder

from .conftest import frame


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_give_the_ids_of_whole_texts(name):
    rng = random.Random(5)
    bits = ["the", "Etre", "été", " ", " ", " ", "\n", "\n", "  ", "'s", "'", "3", "42", ".", ",", "́", "\t", " ", "\x1c",
            "<|endoftext|>", "<|", "你", "\U0001f600", "\0", "İ", "re", " ", "\u0085", "Σ", "-", "%%%", "​", "᠎", "Å"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["".join(rng.choice(bits[:10] + ["a", "b.", "ÀÉß", "x_y", "(z)", "A1."]) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    tk, enc = library(name), ChunkEncoder(name)
    got = map(enc.encode, texts)
    for text, raw in zip(texts, got, strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == tk.encode(text, add_special_tokens=False).ids, repr(text)


def test_heap_merging_counts_as_the_library():
    rng = random.Random(6)
    tk, own = library("byte_bpe_50k.json"), token_count.TokenCounter("byte_bpe_50k.json")
    bits = ["the", "tion", "é", " ", "  ", "\n", "'s", "'ll", "4", "..", "\t", " ", "\x1c", "\x85", "<|endoftext|>", "你", "\U0001f600", "aaaaaaa", "\0", "²"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert own.count(text) == len(tk.encode(text, add_special_tokens=False).ids), repr(text)


def test_counts_of_tables(odd, empty, documents):
    tk = library("byte_bpe_50k.json")
    for docs in (odd, documents):
        got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.token_counts(docs).collect())
        want = []
        for r in docs.select("doc_id", "text").collect():
            n = len(tk.encode(r.text or "", add_special_tokens=False).ids)
            want.append((str(r.doc_id), len((r.text or "").encode()), n, n > 1024))
        assert got == sorted(want)
    assert token_count.token_counts(empty).count() == 0


def test_token_files_round_trip(spark, odd, empty, documents, tmp_path):
    tk = library("byte_bpe_50k.json")
    for k, docs in enumerate((odd, documents)):
        folder = f"file://{tmp_path}/{k}"
        index = token_files.write_token_files(docs, folder)
        got = token_files.read_token_files(index, folder).collect()
        rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
        want, at = [], 0
        for r in rows:
            ids = [*tk.encode(r.text or "", add_special_tokens=False).ids, 2]
            want.append((r.doc_id, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
            at += len(ids)
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    folder = f"file://{tmp_path}/none"
    assert token_files.read_token_files(token_files.write_token_files(empty, folder), folder).count() == 0


def test_packing_places_every_id_once(odd, empty, documents):
    tk = library("word_bpe_49k.json")
    for docs in (odd, documents):
        rows = packing.pack_documents(docs).collect()
        left = defaultdict(list)
        for r in docs.select("doc_id", "text").collect():
            left[r.doc_id].append([*tk.encode(r.text or "", add_special_tokens=False).ids, 1])
        want = sorted(
            (str(doc), low, len(ids[low : low + 2048]), zlib.crc32(np.asarray(ids[low : low + 2048], "<u4").tobytes()), len(ids))
            for doc, all_ids in left.items() for ids in all_ids for low in range(0, len(ids), 2048)
        )
        assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
        bins = defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        for placed in bins.values():
            end = 0
            for offset, length in sorted(placed):
                assert offset == end
                end += length
            assert end <= 2048
    total = sum(r.length for r in rows)
    assert len(bins) <= total / 2048 * 1.02 + 1
    assert packing.pack_documents(empty).count() == 0


def test_equal_rows_are_many_groups(spark):
    """A table that is mostly one row: no group grows with it, and a document's pieces are one group's."""
    rows = [(None, "")] * 20_000 + [(5, "same text")] * 5000 + [(k, "word " * 9000) for k in range(100, 110)]
    docs = frame(spark, rows).repartition(6)
    got = packing.pack_documents(docs, group_docs=500).collect()
    members, of = defaultdict(int), defaultdict(set)
    for r in got:
        members[r.sequence_id >> 32] += r.start == 0
        of[r.doc_id].add(r.sequence_id >> 32)
    assert sum(members.values()) == len(rows) and max(members.values()) < 1000 and len(members) >= 45
    assert all(len(of[k]) == 1 for k in range(100, 110))
    used = defaultdict(int)
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048


def test_tournament_tree_is_first_fit():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 500)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room = []
    for k in np.argsort(-lengths, kind="stable"):
        at = next((i for i, r in enumerate(room) if r >= lengths[k]), len(room))
        room += [100] * (at == len(room))
        assert bins[k] == at and offsets[k] == 100 - room[at]
        room[at] -= lengths[k]
