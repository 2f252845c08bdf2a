import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codicil.llm.cutting_stock import CuttingStockConfig, greedy, knapsack, packed_pieces, solve
from codicil.llm.token_packing import CapacityTree, TokenPackingConfig, best_fit_decreasing, packed_tokens, unpacked_tokens
from codicil.llm.tokens import encoder

from .helpers import documents, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids if x else []


TEXTS = ["hello world", None, "", "Ünïcode — текст 漢字 🙂", "  many   blanks \n\n\t x", "a <|endoftext|> b", "it's we'll I'd", prose(1, 3000), prose(2, 40_000), "x" * 50_000, " " * 300_000 + "end", "1234567 89"] + [prose(k, 20 * k + 1) for k in range(60)]


def test_ids_are_those_of_the_tokenizer(spark, reference):
    encode = encoder(spark, PATH)()
    for t in TEXTS:
        if t:
            assert encode(t).tolist() == reference(t)


def test_token_packing_round_trip(spark, reference):
    docs = documents(spark, TEXTS)
    rows = packed_tokens(docs, TokenPackingConfig(tokenizer=PATH, length=512, block_tokens=20_000)).cache()
    back = {}
    for r in sorted(unpacked_tokens(rows).collect(), key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(back.setdefault(r.doc_id, []))
        back[r.doc_id] += r.ids
    assert back == {i: reference(t) + [50256] for i, t in enumerate(TEXTS)}
    for r in rows.collect():
        assert len(r.input_ids) == 512 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 512
        assert r.cu_seqlens[:-1] == r.position_resets and len(r.doc_ids) == len(r.starts) == len(r.position_resets)
        assert set(r.input_ids[r.n_tokens :]) <= {50256}
    assert len({r.sequence_id for r in rows.collect()}) == rows.count()
    assert packed_tokens(docs.where("false"), TokenPackingConfig(tokenizer=PATH)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_decreasing_equals_a_linear_search(sizes):
    free, want = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [f for f in free if f >= sizes[i]]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - sizes[i])
        else:
            free.append(64 - sizes[i])
        want.append(i)
    bins = best_fit_decreasing(sizes, 64)
    assert sorted(64 - sum(sizes[i] for i in b) for b in bins) == sorted(free)
    assert sorted(i for b in bins for i in b) == sorted(want)


def test_capacity_tree_takes_the_fullest_that_fits():
    t = CapacityTree(10)
    for b, f in enumerate((3, 7, 5)):
        t.put(f, b)
    assert [t.take(4), t.take(4), t.take(4), t.take(1)] == [(5, 2), (7, 1), None, (3, 0)]


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 50), min_size=1, max_size=12))
def test_cutting_stock_covers_the_demand(demand):
    sizes = np.array(sorted(demand))
    b = np.array([demand[s] for s in sizes])
    patterns, counts = solve(sizes, b, 30, 1e-6)
    assert (patterns.T @ counts == b).all() and (patterns @ sizes <= 30).all() and (counts > 0).all()
    best = max(-(-int((sizes * b).sum()) // 30), int(b[sizes > 15].sum()))
    assert counts.sum() <= 1.25 * best + len(sizes)


@pytest.mark.parametrize(("sizes", "demand", "capacity", "best"), [([3, 4], [200, 100], 10, 100), ([7, 8, 11], [200, 200, 200], 26, 200)])
def test_the_program_beats_greedy_patterns(sizes, demand, capacity, best):
    sizes, demand = np.array(sizes), np.array(demand)
    patterns, counts = solve(sizes, demand, capacity, 1e-6)
    assert (patterns.T @ counts == demand).all()
    assert counts.sum() <= best + len(sizes) and sum(greedy(sizes, demand, capacity)[1]) > counts.sum()


def test_the_program_ends_within_its_gap():
    rng = np.random.default_rng(4)
    sizes = np.arange(1, 257)
    demand = rng.integers(0, 60, 256) * (rng.random(256) < 0.6)
    sizes, demand = sizes[demand > 0], demand[demand > 0]
    patterns, counts = solve(sizes, demand, 512, 1e-3)
    assert (patterns.T @ counts == demand).all() and counts.sum() <= 1.01 * (sizes @ demand) / 512 + 2


def test_knapsack_prices_the_best_pattern():
    value, counts = knapsack(np.array([0.4, 0.35, 0.6]), np.array([4, 3, 6]), 10)
    assert abs(value - 1.1) < 1e-12 and counts.tolist() in ([1, 2, 0], [0, 3, 0]) or value > 1.1 - 1e-12


def test_pieces_cover_every_id_once(spark, reference):
    texts = TEXTS + ["hello world"]
    docs = documents(spark, texts, [*range(len(TEXTS)), 0])
    rows = packed_pieces(docs, CuttingStockConfig(tokenizer=PATH)).collect()
    ids = {i: reference(t) + [1] for i, t in enumerate(TEXTS)}
    spans, sequences = {}, {}
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        spans.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, s in spans.items():
        assert sum(n for _, n in s) == len(ids[i]) * (2 if i == 0 else 1)
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
    assert packed_pieces(docs.where("false"), CuttingStockConfig(tokenizer=PATH)).count() == 0


def test_little_padding(spark, sf_dir):
    rows = packed_pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), CuttingStockConfig(tokenizer=PATH)).groupBy("sequence_id").sum("length").collect()
    total = sum(r[1] for r in rows)
    assert 2048 * len(rows) < 1.02 * total


def test_markers_are_the_ids_of_the_tokenizer_as_loaded(spark, tmp_path):
    from tokenizers import Tokenizer

    from codicil.llm.queries import op1_token_packing, op9_cutting_stock_packing

    t = Tokenizer.from_file(PATH)
    mark = "<|endoftext|>"
    texts = [x for x in TEXTS if x] + [mark, mark * 3, f"x{mark}y", f"a\n{mark}\n b", f"<|endoftext|{mark}", " " * 300_000 + f"{mark} end"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert want[texts.index(f"x{mark}y")] == [87, 50256, 88]
    encode = encoder(spark, PATH, True)()
    assert [encode(x).tolist() for x in texts] == want
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = op9_cutting_stock_packing(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.doc_tokens) for r in pieces} == {(i, len(x) + 1) for i, x in enumerate(want)}
    for r in pieces:
        if r.start + r.length <= len(want[r.doc_id]):
            assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    back = {}
    for r in sorted(unpacked_tokens(op1_token_packing(spark, str(tmp_path))).collect(), key=lambda r: (r.doc_id, r.start)):
        back[r.doc_id] = back.get(r.doc_id, []) + r.ids
    assert back == {i: x + [50256] for i, x in enumerate(want)}
