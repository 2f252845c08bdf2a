"""Full-text search by postings: weighted fields, OR of prefixes, phrases.

A matched position counts its field's weight once, however many terms reach it.  A table of
questions with at most ``SENT_TERMS`` terms goes to every executor: the words of a few hundred
chunks are folded to (chunk, word, count) where they are read and meet the questions that each
word answers, so no posting is shuffled and only the best of a task are ranked.
Beyond that, terms meet the vocabulary, not the postings, so a prefix costs its distinct words
and the postings are joined by equality.  Scores are rounded to nine places, so that ties are
ties whatever the order of sums.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..functions.text import tokens
from ..session import ship, small, spread

# Weights of the fields.
FIELD_WEIGHTS = {"law_name": 1.0, "heading": 0.4, "text": 0.2}
PLAIN_WEIGHT = 0.1
#: Terms of all questions that are sent to every executor at most.
SENT_TERMS = 100_000
#: Chunks that are scored at once at most, pairs of a chunk and a question that are held, and words a task remembers.
ROWS, PAIRS, SEEN_WORDS = 512, 1 << 21, 200_000


def postings(chunks: DataFrame, fields: dict[str, float] = FIELD_WEIGHTS, key: str = "chunk_id") -> DataFrame:
    """key, field, weight, pos, lexeme of every word of the fields; no shuffle."""
    each = [F.struct(F.lit(f).alias("field"), F.lit(w).cast("double").alias("weight"), tokens(F.coalesce(F.col(f), F.lit(""))).alias("words")) for f, w in fields.items()]
    rows = chunks.select(key, F.explode(F.array(*each)).alias("f"))
    return rows.select(key, "f.field", "f.weight", F.posexplode("f.words").alias("pos", "lexeme"))


def vocabulary(posts: DataFrame) -> DataFrame:
    return posts.select("lexeme").distinct()


def expand_prefixes(terms: DataFrame, vocab: DataFrame, least: int = 2) -> DataFrame:
    """(query_id, lexeme) of all words that begin with a query's terms.

    Words and terms meet on their first ``least`` characters, an equality that shuffles like any
    join; the rest of the prefix is checked on what meets.
    """
    head = lambda c: F.substring(c, 1, least)
    terms = terms.where(F.length("term") >= least).select("query_id", "term", head(F.col("term")).alias("head"))
    words = vocab.select("lexeme", head(F.col("lexeme")).alias("head"))
    return terms.join(words, "head").where(F.startswith("lexeme", "term")).select("query_id", "lexeme").distinct()


def or_scores(posts: DataFrame, expanded: DataFrame, key: str = "chunk_id") -> DataFrame:
    """query_id, key, weight: the weights of the distinct matched positions, summed.

    ``expanded`` is distinct on (query_id, lexeme) and a position holds one lexeme, so no
    position can match a query twice.
    """
    return posts.join(expanded, "lexeme").groupBy("query_id", key).agg(F.round(F.sum("weight"), 9).alias("weight"))


def batch_scores(chunks: DataFrame, terms: DataFrame, fields: dict[str, float], key: str, k: int | None = None, least: int = 2, masks: DataFrame | None = None, phrases: DataFrame | None = None, titles: bool = False) -> DataFrame:
    """query_id, key, weight as by ``or_scores``, n (words of the fields) and hit (a phrase stands in the chunk), without a
    shuffle; of each task's chunks the ``k`` best for a question (or all) in the order of ``sparse_branch`` or, with
    ``titles``, of ``title_branch``.

    ``terms`` and ``phrases`` (query_id, ix, words) are collected: SENT_TERMS rows each at most.  The places of a phrase
    count like those of words, each place once.  Matches are kept as pairs of a chunk and a
    question, PAIRS at a time, and a task holds ``k`` rows for each question besides.  With
    ``masks`` (query_id, mask) a question meets the chunks whose ``bit`` its mask has.
    """
    import numpy as np

    spark = chunks.sparkSession
    ship(spark)
    asked = terms.where(F.length("term") >= least).select("query_id", "term").distinct().toPandas()
    said = [] if phrases is None else phrases.where("size(words) > 0").select("query_id", "words").distinct().collect()
    queries = np.unique(np.concatenate([asked["query_id"].to_numpy(), np.array([r[0] for r in said], dtype=asked["query_id"].dtype)]))
    places = np.searchsorted(queries, asked["query_id"].to_numpy())
    by_term: dict[str, set[int]] = {}
    for term, place in zip(asked["term"], places):
        by_term.setdefault(term, set()).add(int(place))
    by_phrase: dict[tuple, set[int]] = {}
    for q, words in said:
        by_phrase.setdefault(tuple(words), set()).add(int(np.searchsorted(queries, q)))
    allowed = None
    if masks is not None:
        of = dict(masks.join((terms if phrases is None else terms.select("query_id").union(phrases.select("query_id"))).select("query_id").distinct(), "query_id", "left_semi").select("query_id", "mask").collect())
        allowed = np.array([of.get(q, -1) for q in queries.tolist()], dtype=np.int64)
    sent, weights = spark.sparkContext.broadcast((queries, by_term, by_phrase, allowed)), list(fields.values())

    def run(batches):
        import pyarrow as pa

        ids, wanted, phrased, allowed = sent.value
        none = np.zeros(0, dtype=np.int64)

        def ragged(lists):
            """The sorted lists end to end, where each begins, and their lengths."""
            size = np.array([len(x) for x in lists], dtype=np.int64)
            return np.array([y for x in lists for y in sorted(x)], dtype=np.int64), np.cumsum(size) - size, size

        def reaching(values: dict) -> list[set]:
            """For each text, the values of those that begin it, and its own; none for the last, which stands for no text."""
            out: dict[str, set] = {}
            for text in sorted(values, key=len):
                own = [out[text[:n]] for n in range(1, len(text)) if text[:n] in out]
                out[text] = values[text].union(*own)
            return [*(out[x] for x in values), set()]

        term_no = {t: i for i, t in enumerate(wanted)}
        whole = {w: i for i, w in enumerate(sorted({w for p in phrased for w in p[:-1]}))}
        ends = {w: i for i, w in enumerate(sorted({p[-1] for p in phrased}))}
        asks, asks_begin, asks_size = ragged(reaching(wanted))
        end, end_begin, end_size = ragged(reaching({w: {i} for w, i in ends.items()}))
        # What a word begins with, as far as a term or the last word of a phrase begins so: the longest term and last word up to there.
        begun: dict[str, tuple[int, int]] = {"": (-1, -1)}
        for text in sorted({*wanted, *ends}):
            for n in range(1, len(text) + 1):
                if (head := text[:n]) not in begun:
                    t, e = begun[head[:-1]]
                    begun[head] = (term_no.get(head, t), ends.get(head, e))
        # By the length of a phrase: its words but the last (their numbers), the last one and its questions.
        lengths = {}
        for n in sorted({len(p) for p in phrased}):
            own = sorted((p for p in phrased if len(p) == n), key=lambda p: whole.get(p[0], -1) if n > 1 else 0)
            parts = np.array([[whole[w] for w in p[:-1]] for p in own], dtype=np.int64).reshape(len(own), n - 1)
            lengths[n] = (parts, np.array([ends[p[-1]] for p in own]), *ragged([phrased[p] for p in own]))
        term_codes = np.repeat(np.arange(len(asks_size)), asks_size) * len(ids) + asks
        end_codes = np.repeat(np.arange(len(end_size)), end_size) * (len(ends) + 1) + end

        seen: dict[str, tuple[int, int, int]] = {}

        def known(word: str) -> tuple[int, int, int]:
            """The longest term and the longest last word of a phrase that begin the word, and its number in phrases; -1 for none."""
            if (found := seen.get(word)) is None:
                if len(seen) >= SEEN_WORDS:
                    seen.clear()
                longest = begun[""]
                for n in range(1, len(word) + 1):
                    if (more := begun.get(word[:n])) is None:
                        break
                    longest = more
                found = seen[word] = (*longest, whole.get(word, -1))
            return found

        def among(code, codes):
            """Which of ``code`` are in the sorted ``codes``."""
            if not len(codes):
                return np.zeros(len(code), dtype=bool)
            return codes[np.minimum(np.searchsorted(codes, code), len(codes) - 1)] == code

        def dealt(begin, size):
            """The indexes begin, begin + 1, ... of each range."""
            return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))

        def blocks(size):
            """Ranges of items whose sizes sum up to PAIRS, or a single item."""
            each, at = np.cumsum(size), 0
            while at < len(size):
                to = max(at + 1, int(np.searchsorted(each, (each[at - 1] if at else 0) + PAIRS, side="right")))
                yield at, to
                at = to

        def phrase_places(row, last, number):
            """(place, question) of the words of each phrase, each once, and (row, question) of its hits, as one number each.

            last and number: of the word at each place, the longest last word that begins it and its number in phrases.
            """
            found, hits = [none], [none]
            for n, (parts, ending, flat, begin, size) in lengths.items():
                starts = np.arange(max(0, len(row) - n + 1))
                ok = (row[starts] == row[starts + n - 1]) & (last[starts + n - 1] >= 0)
                for i in range(n - 1):
                    ok &= number[starts + i] >= 0
                starts = starts[ok]
                if n == 1:
                    low, high = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), len(ending))
                else:
                    low, high = (np.searchsorted(parts[:, 0], number[starts], side=s) for s in ("left", "right"))
                for at, to in blocks(high - low):
                    which = dealt(low[at:to], (high - low)[at:to])
                    place = np.repeat(starts[at:to], (high - low)[at:to])
                    fits = among(last[place + n - 1] * (len(ends) + 1) + ending[which], end_codes)
                    for i in range(1, n - 1):
                        fits &= parts[which, i] == number[place + i]
                    which, place = which[fits], place[fits]
                    for lo, hi in blocks(size[which] * n):
                        m = size[which[lo:hi]]
                        q, at_place = flat[dealt(begin[which[lo:hi]], m)], np.repeat(place[lo:hi], m)
                        hits.append(np.unique(row[at_place] * len(ids) + q))
                        found.append(np.unique(np.concatenate([(at_place + i) * len(ids) + q for i in range(n)])))
            return (np.unique(np.concatenate(x)) for x in (found, hits))

        def matched(columns, n):
            """(row * questions + question, weight) of the rows of a batch, in order, and whether a phrase stands there."""
            sums, hits = np.zeros(n * len(ids)), np.zeros(n * len(ids), dtype=bool)
            for column, weight in zip(columns, weights):
                words = column.flatten().dictionary_encode()
                if not len(words):
                    continue
                term, last, number = np.array([known(w) for w in words.dictionary.to_pylist()]).T
                row, word = np.repeat(np.arange(n), column.value_lengths().fill_null(0).to_numpy()), words.indices.to_numpy()
                if lengths:
                    place, hit = phrase_places(row, last[word], number[word])
                    hits[hit] = True
                    q, at = place % len(ids), place // len(ids)
                    # What a single term of the question reaches is counted below.
                    alone = ~among(term[word[at]] * len(ids) + q, term_codes)
                    sums += np.bincount(row[at[alone]] * len(ids) + q[alone], minlength=len(sums)) * weight
                some = term[word] >= 0
                row, word = row[some], term[word[some]]
                for at, to in blocks(asks_size[word]):
                    m = asks_size[word[at:to]]
                    pair = np.repeat(row[at:to] * len(ids), m) + asks[dealt(asks_begin[word[at:to]], m)]
                    sums += np.bincount(pair, minlength=len(sums)) * weight
            pairs = np.flatnonzero(sums)
            return pairs, sums[pairs], hits[pairs]

        def best(q, score, n, hit, keys):
            """The k best rows of each question, ties to the smaller key."""
            # Halves go up, as in the rounding of columns.
            value = np.floor(np.round(score, 9) / (n if titles else score + 1) * 1e9 + 0.5)
            by = (np.unique(keys.to_numpy(zero_copy_only=False), return_inverse=True)[1], -value, *((~hit,) if titles else ()), q)
            order = np.lexsort(by)
            ordered = q[order]
            begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            nth = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
            order = order[nth < k]
            return q[order], score[order], n[order], hit[order], keys.take(pa.array(order))

        def rows_of(q, score, n, hit, keys):
            return pa.RecordBatch.from_arrays([pa.array(ids[q]), keys, pa.array(score), pa.array(n), pa.array(hit)], names=["query_id", key, "weight", "n", "hit"])

        held, step = None, max(1, min(ROWS, PAIRS // max(1, len(ids))))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                pairs, score, hit = matched(part.columns[2:], part.num_rows)
                if allowed is not None:
                    meets = part.column(1).to_numpy()[pairs // len(ids)] & allowed[pairs % len(ids)] != 0
                    pairs, score, hit = pairs[meets], score[meets], hit[meets]
                if not len(pairs):
                    continue
                size = sum(c.value_lengths().fill_null(0).to_numpy().astype(np.int64) for c in part.columns[2:])
                q, n, keys = pairs % len(ids), size[pairs // len(ids)], part.column(0).take(pa.array(pairs // len(ids)))
                if k is None:
                    yield rows_of(q, score, n, hit, keys)
                    continue
                new = best(q, score, n, hit, keys)
                held = new if held is None else best(*(np.concatenate(x) for x in zip(held[:4], new[:4])), pa.concat_arrays([held[4], new[4]]))
        if held is not None:
            yield rows_of(*held)

    kind, asks = dict(chunks.dtypes)[key], dict(terms.dtypes)["query_id"]
    words = [tokens(F.coalesce(F.col(f), F.lit(""))).alias(f"_{i}") for i, f in enumerate(fields)]
    bit = F.lit(0).cast("long").alias("bit") if masks is None else F.col("bit")
    rows = spread(chunks.select(key, bit, *fields)).select(key, "bit", *words).mapInArrow(run, f"query_id {asks}, {key} {kind}, weight double, n long, hit boolean")
    return rows.withColumn("weight", F.round("weight", 9))


def _few(terms: DataFrame) -> bool:
    return terms.limit(SENT_TERMS + 1).count() <= SENT_TERMS


def ranked(scores: DataFrame, score: str, key: str, k: int, *before) -> DataFrame:
    """The k best of each query with their rank; ties go to the smaller key."""
    order = Window.partitionBy("query_id").orderBy(*before, F.col(score).desc(), key)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _admitted_pairs(found: DataFrame, chunks: DataFrame, key: str, masks: DataFrame | None) -> DataFrame:
    if masks is None:
        return found
    pairs = found.join(small(masks, 1_000_000), "query_id").join(chunks.select(key, "bit"), key)
    return pairs.where(F.col("bit").bitwiseAND(F.col("mask")) != 0).drop("bit", "mask")


def sparse_branch(chunks: DataFrame, terms: DataFrame, k: int = 40, key: str = "chunk_id", fields: dict[str, float] = FIELD_WEIGHTS, phrases: DataFrame | None = None, masks: DataFrame | None = None) -> DataFrame:
    """query_id, key, score = W / (W + 1), rank of the k best chunks for an OR of prefixes and phrases.

    phrases: query_id, ix, words; the places of a matched phrase count like those of words, each
    place once.  ``masks`` as in ``batch_scores``.
    """
    if _few(terms) and (phrases is None or _few(phrases)):
        found = batch_scores(chunks, terms, fields, key, k, masks=masks, phrases=phrases).select("query_id", key, "weight")
    else:
        posts = postings(chunks, fields, key)
        found = or_scores(posts, expand_prefixes(terms, vocabulary(posts)), key)
        if phrases is not None:
            found = found.unionByName(phrase_scores(posts, phrases, terms, key)).groupBy("query_id", key).agg(F.round(F.sum("weight"), 9).alias("weight"))
        found = _admitted_pairs(found, chunks, key, masks).select("query_id", key, "weight")
    return ranked(found.withColumn("score", F.round(F.col("weight") / (F.col("weight") + 1), 9)).drop("weight"), "score", key, k)


def phrase_places(posts: DataFrame, phrases: DataFrame, key: str = "chunk_id", least: int = 2) -> DataFrame:
    """query_id, key, field, pos, lexeme, weight: the distinct places of the phrases (query_id, ix, words).

    A phrase's words are neighbours in order, the last by prefix.  Its words meet the postings
    by equality (the last one on its first characters, ``least`` at most); what meets is grouped by the
    place where the phrase would begin.
    """
    n = F.size("words")
    each = phrases.select("query_id", "ix", n.alias("n"), F.posexplode("words").alias("i", "word")).withColumn("last", F.col("i") == F.col("n") - 1)
    head = F.when(F.col("last"), F.substring("word", 1, least)).otherwise(F.col("word"))
    each = small(each.withColumn("meet", head), SENT_TERMS)
    at = posts.select(key, "field", "weight", "pos", "lexeme")
    whole = at.join(each.where("not last"), F.col("lexeme") == F.col("meet"))
    heads = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(least)), lambda n: F.substring("lexeme", F.lit(1), n)))
    begun = at.withColumn("head", F.explode(heads)).join(each.where("last"), F.col("head") == F.col("meet")).where(F.startswith("lexeme", "word")).drop("head")
    met = whole.unionByName(begun).withColumn("begin", F.col("pos") - F.col("i"))
    group = ["query_id", "ix", key, "field", "begin"]
    full = met.groupBy(*group).agg(F.first("n").alias("n"), F.collect_set(F.struct("i", "pos", "lexeme", "weight")).alias("at")).where("size(at) = n")
    return full.select("query_id", key, "field", F.explode("at").alias("a")).select("query_id", key, "field", "a.pos", "a.lexeme", "a.weight").distinct()


def phrase_scores(posts: DataFrame, phrases: DataFrame, terms: DataFrame, key: str = "chunk_id", least: int = 2) -> DataFrame:
    """query_id, key, weight of the places that phrases match and no single term of the question does."""
    places = phrase_places(posts, phrases, key, least)
    reached = expand_prefixes(terms, places.select("lexeme").distinct(), least)
    return places.join(reached, ["query_id", "lexeme"], "left_anti").groupBy("query_id", key).agg(F.round(F.sum("weight"), 9).alias("weight"))


def title_branch(chunks: DataFrame, terms: DataFrame, phrases: DataFrame, k: int = 40, key: str = "chunk_id", masks: DataFrame | None = None) -> DataFrame:
    """query_id, key, phrase_hit, score = W / words, rank over headings; chunks with a phrase (query_id, ix, words) come first."""
    titled = chunks.where("heading is not null")
    if _few(terms) and _few(phrases):
        found = batch_scores(titled, terms, {"heading": PLAIN_WEIGHT}, key, k, masks=masks, phrases=phrases, titles=True).withColumnRenamed("hit", "phrase_hit")
    else:
        posts = postings(titled, {"heading": PLAIN_WEIGHT}, key)
        size = titled.select(key, F.size(tokens(F.col("heading"))).alias("n"))
        found = or_scores(posts, expand_prefixes(terms, vocabulary(posts)), key)
        hits = phrase_places(posts, phrases, key).select("query_id", key).distinct().withColumn("phrase_hit", F.lit(True))
        found = found.unionByName(phrase_scores(posts, phrases, terms, key)).groupBy("query_id", key).agg(F.round(F.sum("weight"), 9).alias("weight"))
        found = _admitted_pairs(found, titled, key, masks).select("query_id", key, "weight")
        found = found.join(size, key).join(hits, ["query_id", key], "left").withColumn("phrase_hit", F.coalesce("phrase_hit", F.lit(False)))
    found = found.withColumn("score", F.round(F.col("weight") / F.col("n"), 9)).drop("weight", "n")
    return ranked(found, "score", key, k, F.col("phrase_hit").desc())


def exact_branch(chunks: DataFrame, numbers: DataFrame, limit: int = 12, key: str = "chunk_id", allowed: Column | None = None) -> DataFrame:
    """query_id, key, score 1, rank: chunks of the articles that a question names, by ordinal.

    numbers: query_id, article_number, and what the condition ``allowed`` reads besides.
    """
    found = chunks.join(numbers.distinct(), "article_number")
    if allowed is not None:
        found = found.where(allowed)
    order = Window.partitionBy("query_id").orderBy("ordinal", key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", key, F.lit(1.0).alias("score"), "rank")


def admitted(chunks: DataFrame, languages: list[str] | None = None, act_types: list[str] | None = None, act_ids: list[str] | None = None, in_force_only: bool = False) -> DataFrame:
    """Chunks that fit every given list; an empty list or None asks nothing.  In force are the states in_force and amended."""
    for name, wanted in (("language", languages), ("act_type", act_types), ("act_id", act_ids), ("status", ["in_force", "amended"] if in_force_only else None)):
        if wanted:
            chunks = chunks.where(F.col(name).isin(wanted))
    return chunks
