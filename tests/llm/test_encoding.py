"""Byte-level BPE and edit-aware token counts against tiktoken and whole re-encoding."""

from __future__ import annotations

import base64
import hashlib
import random
import struct
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import bpe, token_counts
from newsloom.llm.queries import encoding

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ODD = [None, "", " ", "\n", "\n\n \n", "a", "  a  b ", "x" * 3000, "ab" * 900 + "\t\r\n", "Größe naïve 東京 🎉🎉", "don't  can't\n\n  stop", "1234567890" * 30, "é​﻿", "%%%$$$ !!!" * 50]


@lru_cache
def theirs() -> tiktoken.Encoding:
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ours(texts):
    v = bpe.vocabulary(PATH, PATTERN)
    return [np.frombuffer(i, "<u4").tolist() for i in v.encode_texts([t or "" for t in texts])]


def test_odd_texts():
    for text, ids in zip(ODD, ours(ODD)):
        assert ids == theirs().encode_ordinary(text or "")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=30))
def test_any_texts(texts):
    v = bpe.vocabulary(PATH, PATTERN)
    ids = v.encode_texts(texts)
    assert [v.decode(i).decode() for i in ids] == texts


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab Té1\n.'s", max_size=200))
def test_any_text_as_tiktoken(text):
    assert ours([text])[0] == theirs().encode_ordinary(text)


def test_side_by_side_trees_give_what_single_trees_give():
    v = bpe.Vocabulary(PATH, PATTERN)
    rng = random.Random(5)
    pieces = [bytes(rng.choice(b"abcdeth ing\xc3\xa9") for _ in range(rng.randint(1, 64))) for _ in range(200)]
    for size in (2, 4, 8, 16, 32, 64):
        mine = [p for p in pieces if 1 << max(len(p) - 1, 1).bit_length() == size]
        if mine:
            got = [np.frombuffer(i, "<u4").tolist() for i in v.merge_side_by_side(mine, size)]
            assert got == [v.merge_one(p) for p in mine]


def test_query_on_a_whole_table(spark, small):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: r for r in encoding.QUERIES["op3_byte_bpe"](spark, small).collect()}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        ids = theirs().encode_ordinary(text)
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table_nulls_repeats_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "ab c", 9, "z"), (1, "ab c", 8, None), (None, None, None, None)], "doc_id long, text string, ids int, n_tokens string")
    got = bpe.encode(rows, PATH, PATTERN).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, bytes(r.decoded)) for r in got) == [(0, 0, b""), (1, 2, b"ab c"), (1, 2, b"ab c")]
    assert bpe.encode(rows.limit(0), PATH, PATTERN).count() == 0
    assert token_counts.edited_counts(rows.limit(0), PATH, PATTERN).count() == 0
    assert sorted(r.n_tokens_edited for r in token_counts.edited_counts(rows, PATH, PATTERN).collect()) == [0, 2, 2]


def edited(text, edits):
    for a, b, new in edits:
        a = min(max(a, 0), len(text))
        b = min(max(b, a), len(text))
        text = text[:a] + new + text[b:]
    return text


EDITS = st.lists(st.tuples(st.integers(-5, 700), st.integers(-5, 700), st.text(alphabet="ab \nT1.'é", max_size=12)), max_size=6)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc dT\n \n1.'éx", max_size=600), EDITS)
def test_edits_count_as_whole_texts(text, edits):
    v = bpe.vocabulary(PATH, PATTERN)
    tree = token_counts.CountedText(v, text, token_counts.counter(v), leaf=16)
    for a, b, new in edits:
        tree.replace(a, b, new)
    whole = edited(text, edits)
    assert tree.text == whole
    assert tree.n_tokens == len(v.encode_texts([whole])[0]) // 4


def test_an_edit_encodes_little_again():
    v = bpe.vocabulary(PATH, PATTERN)
    text = "some words of a long text, one after another. " * 2000
    tree = token_counts.CountedText(v, text, token_counts.counter(v))
    tree.replace(50_000, 50_004, "NEW")
    assert tree.n_tokens == len(v.encode_texts([edited(text, [(50_000, 50_004, "NEW")])])[0]) // 4
    assert tree.reencoded < 1000


def test_redactions_on_a_whole_table(spark, small):
    v = bpe.vocabulary(PATH, PATTERN)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    seen = 0
    for r in token_counts.edited_counts(spark.read.parquet(f"{small}/documents.parquet"), PATH, PATTERN).collect():
        whole = edited(texts[r.doc_id], token_counts.redactions(texts[r.doc_id]))
        assert r.edited == whole
        assert r.n_tokens_edited == len(v.encode_texts([whole])[0]) // 4
        assert r.n_tokens == len(v.encode_texts([texts[r.doc_id]])[0]) // 4
        seen += r.n_edits
    assert seen > 0
