import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codicil.llm import chunk_tokens
from codicil.llm.queries import op12_vector_packing
from codicil.llm.vector_packing import VectorPackingConfig, best_plan, demand_of, vector_best_fit, vector_packed

from .helpers import documents, prose

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
SF = "/root/testdata/sf0.001"

ODD = ["", None, "A <|endoftext|>b x<|startoftext|>", "Ünïcode — текст 漢字 🙂 İΣΑΣ Σ", "é x̧́ ́abc", "a\x1cb\x85c d　e​f", "it's we'll I'D o'Sx", "\n\n\t", "x" * 5000, "ﬁ Ǆ ẛ̣ Å", "don't '' 's 12345 ١٢", "한국어 각", "a\x00b", "﻿hi", "क्षि त्र", "ß ẞ SS"]
ODD += [f"x{chr(i)}Y {chr(i)} a" for i in range(1, 0x500)] + [prose(k, 40 * k) for k in range(30)]


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("most", [1 << 22, 300])
def test_ids_are_those_of_the_library(monkeypatch, most):
    monkeypatch.setattr(chunk_tokens, "TEXT_BYTES", most)
    monkeypatch.setattr(chunk_tokens, "MOST_CHUNKS", most)
    spec = open(PATH, encoding="utf-8").read()
    made = chunk_tokens._Chunks(spec, chunk_tokens._ranks(json.loads(spec)))
    texts = ODD + [r["text"] for r in pa.parquet.read_table(f"{SF}/documents.parquet", columns=["text"]).to_pylist()]
    got = {}
    for row, flat, ends in made.encode(pa.array(texts)):
        at = 0
        for k, to in enumerate(ends.tolist()):
            got[row + k] = flat[at:to].tolist()
            at = to
    assert [got[k] for k in range(len(texts))] == [ids(t) for t in texts]


def test_other_files_are_refused(spark):
    with pytest.raises((ValueError, KeyError, TypeError)):
        chunk_tokens.chunk_encoder(spark, public_tokenizers.path("byte_bpe_50k.json"))


def one_by_one(histogram, capacity, rule):
    """Best fit decreasing, piece by piece over single bins."""
    total = sum(demand_of(s) * n for s, n in histogram.items()) / capacity
    weight, bins = total / total.sum(), []
    for size in sorted(histogram, reverse=True):
        need = demand_of(size)
        for _ in range(histogram[size]):
            fits = [b for b in bins if (b >= need).all()]
            if fits:
                score = (lambda b: (weight * ((b - need) / capacity) ** 2).sum()) if rule == "norm" else (lambda b: -(weight * b / capacity * need / capacity).sum())
                best = min(fits, key=score)
                best -= need
            else:
                bins.append(capacity - need)
    return bins


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 12), min_size=1, max_size=10), st.integers(2, 32), st.integers(300, 1024))
def test_groups_of_bins_do_as_single_bins_do(histogram, most, attention):
    config = VectorPackingConfig(length=32, documents=most, attention=max(attention, max(histogram) ** 2))
    for rule in ("norm", "dot"):
        plan = vector_best_fit(histogram, config.capacity, rule)
        placed = {}
        for pattern, n in zip(plan.patterns, plan.counts):
            used = sum(demand_of(s) * k for s, k in pattern.items())
            assert n > 0 and (used <= config.capacity).all()
            for s, k in pattern.items():
                placed[s] = placed.get(s, 0) + k * n
        assert placed == histogram
        if rule == "norm":
            assert plan.bins == len(one_by_one(histogram, config.capacity, rule))
    assert best_plan(histogram, config).bins <= plan.bins


def checked(rows, texts, config):
    want = {i: ids(t) + [config.end_id] for i, t in texts}
    times = {}
    for i, _ in texts:
        times[i] = times.get(i, 0) + 1
    spans, sequences = {}, {}
    for r in rows:
        whole = want[r.doc_id]
        assert r.start == r.piece * config.piece and r.length == min(config.piece, len(whole) - r.start)
        assert r.ids_crc32 == zlib.crc32(np.array(whole[r.start : r.start + r.length], "<u4").tobytes())
        spans[r.doc_id] = spans.get(r.doc_id, 0) + r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert spans == {i: len(w) * times[i] for i, w in want.items()}
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= config.length and len(s) <= config.capacity[1] and sum(n * n for _, n in s) <= config.capacity[2]
    return len(sequences), sum(map(len, want.values()))


def test_packing_of_odd_rows(spark):
    texts = [*enumerate([t for t in ODD if t is None or len(t) < 4000][:400] + ["word " * 5000, "x" * 9000, prose(7, 6000)]), (0, ""), (3, ODD[3])]
    docs = documents(spark, [t for _, t in texts], [i for i, _ in texts]).withColumnsRenamed({"rank": "length", "lang": "order", "source": "one"})
    for config in (VectorPackingConfig(PATH), VectorPackingConfig(PATH, length=256, documents=5, attention=20_000), VectorPackingConfig(PATH, length=64, rules=("dot",))):
        checked(vector_packed(docs, config).collect(), texts, config)
    again = [sorted(map(tuple, vector_packed(docs.repartition(n), VectorPackingConfig(PATH)).drop("sequence_id").groupBy("offset", "length").count().collect())) for n in (1, 5)]
    assert again[0] == again[1]
    assert vector_packed(docs.where("false"), VectorPackingConfig(PATH)).count() == 0
    null = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert {(r.doc_id, r.length, r.offset) for r in vector_packed(null, VectorPackingConfig(PATH)).collect()} == {(None, 3, 0), (None, 1, 3)}


def test_query_packs_the_table_into_hardly_more_than_the_least(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = [tuple(r) for r in df.collect()]
    got = op12_vector_packing(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    n, tokens = checked(got.collect(), texts, VectorPackingConfig(PATH))
    assert n <= -(-tokens // 2048) + 3
