import random

from codicil.llm.line_dedup import LineDedupConfig, line_deduplicated
from codicil.llm.substring_dedup import PassageConfig, repeated_passages, units, without_passages

from .helpers import documents, edited, prose, words


def brute_lines(rows):
    """rows: (doc_id, text) in any order; ids differ."""
    first, gone = {}, {}
    for i, t in sorted(rows):
        lines = t.split("\n") if t is not None else []
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if not words("".join(w)):
                continue
            if w in first:
                gone.setdefault(i, set()).update((k, k + 1, k + 2))
            else:
                first[w] = i
    return {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in rows}


def test_lines_equal_brute_force(spark):
    a = "\n".join(f"line {k}" for k in range(12))
    rows = [(1, a), (2, "x\n" + a + "\ny"), (3, "line 3\nline 4\nline 5\nz"), (4, "s\ns\ns\ns\ns\ns"), (5, None), (6, ""), (7, "\n\n\n\n"), (8, "one\ntwo"), (9, a), (10, "q\n" * 3000), (11, "line 3\nline 4\nother")]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    for most in (10**6, 0):
        got = {r.doc_id: r for r in line_deduplicated(docs.withColumnRenamed("rank", "n_lines"), LineDedupConfig(broadcast_positions=most)).collect()}
        assert {i: r.text for i, r in got.items()} == brute_lines(rows)
        assert (got[4].n_lines, got[4].n_removed, got[5].n_lines, got[9].text) == (6, 5, 0, "")
    assert line_deduplicated(docs.where("false")).count() == 0


def test_equal_rows_are_one_document_and_null_ids_come_first(spark):
    t = "a\nb\nc\nd"
    got = line_deduplicated(documents(spark, [t, t, t], [5, 5, None])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, t), (5, ""), (5, "")]


def test_no_content_is_lost(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.text for r in line_deduplicated(docs).collect()}
    assert got == brute_lines(rows)
    assert {x for _, t in rows for x in t.split("\n")} == {x for t in got.values() for x in t.split("\n")} - ({""} if "" not in {x for _, t in rows for x in t.split("\n")} else set())


def test_passages_of_fifty_words_are_found_wherever_they_stand(spark):
    passage = prose(5, 51)
    texts = [prose(k, 40 + 7 * k) for k in range(12)]
    for k in (2, 5, 9):
        w = texts[k].split(" ")
        texts[k] = " ".join(w[: 3 * k]) + "\n" * (k % 2) + " " + passage.upper() + " " + " ".join(w[3 * k :])
    texts += [None, "", "short", "short", " \n "]
    got = repeated_passages(documents(spark, texts)).collect()
    assert {(r.doc_id, r.first_doc_id) for r in got} == {(5, 2), (9, 2)}
    for r in got:
        assert words(texts[r.doc_id], True)[r.start : r.start + r.n_words] == words(texts[r.first_doc_id], True)[r.first_start : r.first_start + r.n_words]


def test_driver_table_passages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen, need = {}, set()
    for r in sorted(docs.select("doc_id", "text").collect()):
        w = words(r.text, True)
        for k in range(len(w) - 50):
            if seen.setdefault(tuple(w[k : k + 51]), r.doc_id) != r.doc_id:
                need.add(r.doc_id)
    assert need <= {r.doc_id for r in repeated_passages(docs).select("doc_id").distinct().collect()}


def test_similar_paragraphs_cluster_and_clean_ones_stay(spark):
    p = prose(1, 80)
    texts = [prose(3, 60) + "\n" + p, prose(4, 60) + "\n" + edited(p, 1, 1) + "\n" + prose(5, 30), prose(6, 200), prose(7, 30) + "\n" + edited(p, 40, 2)]
    got = repeated_passages(documents(spark, texts), PassageConfig(run=70, window=5)).collect()
    assert {(r.doc_id, r.first_doc_id, r.n_words) for r in got} == {(1, 0, 80)}
    assert repeated_passages(documents(spark, ["x"]).where("false")).count() == 0
    assert repeated_passages(documents(spark, [p, p], [4, 4])).count() == 0
    assert repeated_passages(documents(spark, [p, p], [None, 4])).count() == 0


def test_every_word_of_a_planted_passage_is_covered(spark):
    texts, planted = [prose(100 + k, 90 + 13 * k) for k in range(14)], []
    for n, (size, holders) in enumerate([(51, (0, 3)), (51, (1, 4, 7)), (80, (2, 5)), (300, (6, 9)), (75, (8, 10, 11))]):
        passage = prose(500 + n, size)
        for j, k in enumerate(holders):
            w = texts[k].split(" ")
            # The last passage goes on for only 55 words in its first occurrence.
            part = passage if n < 4 or j else " ".join(passage.split(" ")[:55])
            texts[k] = " ".join([*w[: 20 + 7 * k], part, *w[20 + 7 * k :]])
            if j:
                planted.append((k, 20 + 7 * k, size if n < 4 or j > 1 else 55))
    got = repeated_passages(documents(spark, texts)).collect()
    for doc_id, start, size in planted:
        covered = {i for r in got if r.doc_id == doc_id for i in range(r.start, r.start + r.n_words)}
        assert covered == set(range(start, start + size))
    for r in got:
        assert words(texts[r.doc_id], True)[r.start : r.start + r.first_words] == words(texts[r.first_doc_id], True)[r.first_start : r.first_start + r.first_words]


def in_lines(text, n):
    w = text.split(" ")
    return "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))


def test_all_text_is_in_some_paragraph():
    import numpy as np
    import pyarrow as pa

    from codicil.llm import _text as X

    r = random.Random(3)
    texts = ["\n".join(prose(100 * k + j, r.choice([1, 2, 5, 9, 19, 20, 33])) for j in range(r.randint(1, 30))) for k in range(60)]
    texts += [in_lines(prose(7, 300), n) for n in (1, 4, 19)] + ["q\n" * 200, prose(1, 5), prose(1, 4), "", None, prose(8, 30) + "\nend", "top\n" + prose(9, 30)]
    ((_, data, offsets),) = X.chunks(pa.array(texts))
    starts, ends, first = X.words(data, offsets)
    edges = np.unique(np.concatenate([first, np.searchsorted(starts, np.flatnonzero(data == 10))]))
    covered = {}
    for a, b in zip(*units(np, X.mix, X.word_hashes(data, starts, ends), edges[:-1], edges[1:], first, 20, 5)):
        i = int(np.searchsorted(first, a, side="right")) - 1
        assert b <= first[i + 1] and (b - a >= 20 or b - a == len(words(texts[i])))
        covered.setdefault(i, set()).update(range(a - first[i], b - first[i]))
    for i, t in enumerate(texts):
        n = len(words(t))
        assert covered.get(i, set()) == (set(range(n)) if n >= 5 else set())


def test_passages_in_short_lines_with_changed_words_are_found(spark):
    p = prose(1, 400)
    w = p.split(" ")
    for i in range(30, 400, 60):
        w[i] = f"new{i}"
    texts = [in_lines(prose(3, 63), 7) + "\n" + in_lines(p, 8), in_lines(prose(4, 40), 5) + "\n" + in_lines(" ".join(w), 8) + "\n" + prose(5, 30), in_lines(prose(6, 300), 8)]
    got = repeated_passages(documents(spark, texts), PassageConfig(run=70, window=5)).collect()
    assert {(r.doc_id, r.first_doc_id) for r in got} == {(1, 0)}
    assert sum(r.n_words for r in got) >= 150


def test_similar_paragraphs_rarely_share_no_bucket():
    c = PassageConfig()
    assert (1 - 0.8**c.rows) ** c.bands < 3e-6


def test_spans_are_disjoint_and_cut_from_the_text(spark):
    passage, texts = prose(77, 90), [prose(k, 120) for k in range(4)]
    for k in (0, 1, 3):
        w = texts[k].split(" ")
        texts[k] = " ".join(w[:40]) + "\n" + passage + " " + " ".join(w[40:])
    texts += [texts[1], None, ""]
    docs = documents(spark, texts)
    removed = repeated_passages(docs)
    rows = removed.collect()
    for i in {r.doc_id for r in rows}:
        spans = sorted((r.start, r.start + r.n_words) for r in rows if r.doc_id == i)
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:])) and all(b - a >= 50 for a, b in spans)
    left = {r.doc_id: r for r in without_passages(docs.withColumnRenamed("rank", "start"), removed).collect()}
    assert [left[k].text for k in (0, 2, 5, 6)] == [texts[0], texts[2], None, ""]
    for k in (1, 3):
        w = texts[k].replace("\n", " ").split(" ")
        assert words(left[k].text) == w[:40] + w[130:]
    assert words(left[4].text) == [] and left[4].start == "x"


def test_precision_and_recall_by_words_against_brute_force(spark, sf_dir):
    """Every later copy of a 51-word run is covered, and every covered word is repeated or in a similar paragraph."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    seen, need, texts = {}, {}, {r.doc_id: words(r.text, True) for r in docs.collect()}
    for i in sorted(texts):
        w = texts[i]
        for k in range(len(w) - 50):
            if seen.setdefault(tuple(w[k : k + 51]), i) != i:
                need.setdefault(i, set()).update(range(k, k + 51))
    got = {}
    for r in repeated_passages(docs).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_words))
    missed = sum(len(n - got.get(i, set())) for i, n in need.items())
    assert missed <= 0.03 * sum(map(len, need.values()))
    # Runs of 10 words that occur more than once: what is covered lies in such runs but for changed words.
    counts = {}
    for i, w in texts.items():
        for k in range(len(w) - 9):
            key = tuple(w[k : k + 10])
            counts[key] = counts.get(key, 0) + 1
    wrong = total = 0
    for i, covered in got.items():
        w = texts[i]
        repeated = {k + j for k in range(len(w) - 9) if counts[tuple(w[k : k + 10])] > 1 for j in range(10)}
        total += len(covered)
        wrong += len(covered - repeated)
    assert wrong <= 0.03 * total


def test_words_between_short_matches_stay(spark):
    """Pairs of documents with two common passages below the limit around different words."""
    texts = []
    for k in range(60):
        gap, one, two = (8, 14, 20, 26)[k % 4], prose(9000 + k, 48), prose(9100 + k, 48)
        for side in (0, 1):
            texts.append(" ".join([prose(9200 + 2 * k + side, 40), one, prose(9400 + 2 * k + side, gap), two, prose(9600 + 2 * k + side, 40)]))
    assert repeated_passages(documents(spark, texts)).count() == 0


def test_a_long_passage_keeps_to_its_words_and_one_changed_word_joins(spark):
    texts, want = [], {}
    for k, gap in enumerate((1, 3, 8, 26, 1, 3)):
        one, two = prose(7000 + k, 60), prose(7100 + k, 60)
        for side in (0, 1):
            texts.append(" ".join([prose(7200 + 2 * k + side, 30), one, prose(7400 + 2 * k + side, gap), two, prose(7600 + 2 * k + side, 30)]))
        want[2 * k + 1] = [(30, 120 + gap)] if gap < 5 else [(30, 60), (90 + gap, 60)]
    got = {}
    for r in repeated_passages(documents(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_words))
    assert {i: sorted(x) for i, x in got.items()} == want


def test_windows_choose_the_first_smallest_place():
    import numpy as np

    from codicil.llm.substring_dedup import runs

    r = np.random.default_rng(4)
    for size, window in ((20, 31), (4, 5), (7, 1), (5, 8)):
        n = np.concatenate([r.integers(0, 120, 40), [0, size - 1, size, size + window - 2, size + window - 1, size + window, 0]])
        first = np.concatenate([[0], np.cumsum(n)])
        # Few different values: ties within windows, as in texts that say one phrase over and over.
        anchor = (r.integers(0, 9, int(first[-1]) - 3).astype(np.uint64)) << np.uint64(40)
        want = set()
        for a, b in zip(first[:-1], first[1:]):
            values = anchor[a : max(a, b - size + 1)]
            for k in range(max(1, len(values) - window + 1) if len(values) else 0):
                want.add(int(a + k + values[k : k + window].argmin()))
        assert runs(np, anchor, first, size, window).tolist() == sorted(want)


def test_matches_deep_inside_others_are_not_grown_and_removals_are_the_same(spark, monkeypatch):
    import pyspark.sql.functions as F

    from codicil.llm import substring_dedup as S

    r, texts, inner = random.Random(8), [], []
    for k in range(30):
        phrase, edge = prose(300 + k % 5, 1 + k % 5), prose(400 + k % 3, r.randint(0, 25))
        spam = " ".join([phrase] * r.randint(30, 150))
        texts.append(" ".join([prose(500 + k, r.randint(0, 40)), edge, spam, edge, prose(600 + k, r.randint(0, 40)), prose(700 + k % 4, 60)]))
    docs, grown = documents(spark, texts), S.grown
    got = sorted(map(tuple, repeated_passages(docs).collect()))

    def all_grown(docs, spans, config):
        inner.append((spans.where("inner").count(), spans.count()))
        return grown(docs, spans.withColumn("inner", F.lit(False)), config)

    monkeypatch.setattr(S, "grown", all_grown)
    assert got and got == sorted(map(tuple, repeated_passages(docs).collect()))
    assert inner[0][0] > 0.2 * inner[0][1]
