"""Packing: ids as the tokenizer gives them, every piece once and in place, few sequences."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from newsloom.llm import packing
from newsloom.llm.queries import encoding

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


def ids_of(text: str | None) -> list[int]:
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, texts: dict, capacity: int) -> int:
    """Every piece of every document is there once, and sequences are gapless; how many there are."""
    at, seen = defaultdict(list), defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id].append(r)
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
    assert set(seen) == set(texts)
    for doc, found in seen.items():
        ids, end = ids_of(texts[doc]), 0
        for k, r in enumerate(sorted(found, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, end)
            assert r.length == capacity or k == len(found) - 1
            assert r.ids_crc32 == zlib.crc32(np.array(ids[end : end + r.length], dtype="<u4").tobytes())
            end += r.length
        assert end == len(ids)
    return len(at)


def best_fit(lengths: Counter, capacity: int) -> int:
    plain = packing.Sequences(capacity)
    for length in sorted(lengths, reverse=True):
        plain.best_fit(length, lengths[length])
    return plain.used


def test_a_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = encoding.op11_packing(spark, small).collect()
    assert rows[0].asDict().keys() == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    used = check(rows, {r.doc_id: r.text for r in docs.collect()}, 2048)
    lengths = Counter(r.length for r in rows)
    assert used <= max(best_fit(lengths, 2048), -(-sum(n * k for n, k in lengths.items()) // 2048) + 1)


def test_nulls_repeats_long_texts_and_extra_columns(spark):
    texts = {1: None, 2: "", 3: "One two " * 40_000, 4: "x" * 300_000, 5: "same text", 6: "same text", 7: "<|endoftext|> a", 8: "é ́ Σ ΑΣ\x1cb c \x85"}
    rows = [(k, t, 1, "s") for k, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, bucket string")
    check(packing.pack(docs, PATH, 512).collect(), texts, 512)
    assert packing.pack(docs.where("false"), PATH).count() == 0
    again = packing.pack(spark.createDataFrame([(None, "a b"), (None, None), (9, "a b"), (9, "a b")], "doc_id long, text string"), PATH).collect()
    assert sorted((r.doc_id or 0, r.length) for r in again) == [(0, 1), (0, 3), (9, 3), (9, 3)] and len({(r.sequence_id, r.offset) for r in again}) == 4


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abA's \t\n\x0b\x0c\r\x1c\x85 ́ͅΣÅ가가<|endoftext|>3"), st.characters(codec="utf-8"))))
def test_words_are_encoded_apart(text):
    assert np.frombuffer(packing.word_ids(PATH)([text])[0], dtype="<u4").tolist() == ids_of(text)[:-1]


def filled(counts: dict[int, int], capacity: int) -> int:
    """Checks a plan against its counts; the sequences that it takes."""
    held, numbers = Counter(), defaultdict(list)
    for length, first, end, each, sequence, offset in packing.plan(counts, capacity):
        numbers[length].append((first, end))
        assert (end - first) % each == 0 and offset + each * length <= capacity
        for k in range(first, end):
            held[sequence + (k - first) // each] += length
    for length, n in counts.items():
        spans = sorted(numbers[length])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert max(held.values()) <= capacity and sorted(held) == list(range(len(held)))
    return len(held)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), min_size=1))
def test_plans_are_whole(counts):
    assert filled(counts, 60) <= best_fit(Counter(counts), 60)


@pytest.mark.parametrize(("low", "high"), [(300, 1100), (600, 1030), (680, 690)])
def test_grouping_saves_sequences(low, high):
    counts = Counter(np.random.default_rng(3).integers(low, high, 20_000).tolist())
    assert filled(counts, 2048) <= best_fit(counts, 2048) * 1.0005 and len(packing.plan(counts, 2048)) < 8 * 2048


def test_configurations_meet_the_demand():
    sizes, demand = [900, 700, 400], [50, 80, 200]
    found = packing.configurations(sizes, demand, 2048)
    assert all(sum(a * s for a, s in zip(config, sizes)) <= 2048 for config, _ in found)
    for i, n in enumerate(demand):
        assert sum(config[i] * use for config, use in found) == pytest.approx(n)
    tokens = sum(n * size for n, size in zip(demand, sizes)) / 2048
    assert tokens <= sum(use for _, use in found) <= tokens * 1.05
