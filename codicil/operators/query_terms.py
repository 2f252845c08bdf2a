"""What a question asks of the lexical branches: words in all scripts, synonyms, shortened forms and phrases.

Everything is columns and joins: a question is exploded into its spellings, the runs of
neighbouring content words of each meet a table of synonyms by equality, and what was found comes
back in order, is made distinct and cut at ``Config.term_cap`` terms.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..config import DEFAULT
from ..functions import text as T
from ..functions.translit import latin_to_cyrillic, script_variants
from ..session import small

#: Synonyms that are sent to every executor at most.
SENT = 100_000


def family(language: Column) -> Column:
    """uz, ru or en: which framing words a language has."""
    return F.when(language.startswith("uz"), "uz").when(language == "ru", "ru").otherwise("en")


def normalised_phrase(phrase: Column) -> Column:
    return F.array_join(F.transform(F.split(F.trim(phrase), "\\s+"), T.normalise_token), " ")


def synonym_table(groups: DataFrame) -> DataFrame:
    """phrase, synonym of groups (group, term, english): each member leads to all others that are not English.

    Members that are not English count in Cyrillic too.  A term in several groups leads to the
    members of all.
    """
    term = F.col("term")
    forms = F.when(F.col("english"), F.array(normalised_phrase(term))).otherwise(F.array(normalised_phrase(term), normalised_phrase(latin_to_cyrillic(term))))
    # A form that is English anywhere is no synonym.
    members = groups.select("group", "english", F.explode(F.array_distinct(forms)).alias("form")).where("form <> ''")
    english = members.where("english").select(F.col("form").alias("synonym")).distinct()
    given = members.select("group", F.col("form").alias("synonym")).distinct().join(english, "synonym", "left_anti")
    pairs = members.select("group", F.col("form").alias("phrase")).distinct().join(given, "group").where("phrase <> synonym")
    return pairs.select("phrase", "synonym").distinct()


def _by_family(column: Column, language: Column) -> Column:
    kind = family(language)
    return F.when(kind == "uz", T.content_tokens(column, "uz")).when(kind == "ru", T.content_tokens(column, "ru")).otherwise(T.content_tokens(column, "en"))


def contents(questions: DataFrame) -> DataFrame:
    """query_id, language, variant, content: the content words of each spelling of the questions (query_id, text, language)."""
    spellings = F.when(F.col("language") == "en", F.array("text")).otherwise(script_variants(F.col("text")))
    spelled = questions.select("query_id", "language", F.posexplode_outer(spellings).alias("variant", "spelling"))
    content = _by_family(F.coalesce("spelling", F.lit("")), F.col("language"))
    return spelled.select("query_id", "language", "variant", F.coalesce(content, F.array().cast("array<string>")).alias("content"))


def additions(spelled: DataFrame, synonyms: DataFrame, longest: int = 6) -> DataFrame:
    """query_id, language, variant, size, start, term: the synonyms of each run of up to ``longest`` content words."""
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(T.ngrams(F.col("content"), n), lambda p: F.struct(n.alias("size"), p.alias("phrase")))))
    found = spelled.select("query_id", "language", "variant", "content", F.posexplode(runs).alias("start", "run"))
    found = found.select("query_id", "language", "variant", "content", "start", "run.size", "run.phrase").join(small(synonyms, SENT), "phrase")
    # Words that the question has are no additions.
    found = found.where(~F.array_contains("content", F.col("synonym")))
    return found.select("query_id", "language", "variant", "size", "start", F.col("synonym").alias("term"))


def query_terms(questions: DataFrame, synonyms: DataFrame | None = None, cap: int = DEFAULT.term_cap, longest: int = 6) -> DataFrame:
    """query_id, ix, words of questions (query_id, text, language): the terms of each in order, from 0.

    A term of several words is a phrase.  For each spelling (English has one) come the content
    words, then the synonyms (phrase, synonym) of each run of up to ``longest`` of them, shorter
    runs and earlier ones first, synonyms of one run in order; each with its shortened form,
    but in English.  The first ``cap`` distinct ones are kept.  A question without content words
    is its own text, and ``x`` without text.
    """
    q = questions.select("query_id", F.coalesce("text", F.lit("")).alias("text"), "language")
    spelled = contents(q)
    own = spelled.select("query_id", "language", "variant", F.posexplode("content").alias("start", "term"))
    raw = own.select("query_id", "language", "variant", F.lit(0).alias("size"), "start", "term")
    if synonyms is not None:
        raw = raw.unionByName(additions(spelled, synonyms, longest))
    forms = F.when(F.col("language") == "en", F.array("term")).otherwise(T.stem_variants(F.col("term")))
    rows = raw.select("query_id", F.struct("variant", "size", "start", "term").alias("at"), forms.alias("forms"))
    listed = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("at", "forms"))).alias("found"))
    listed = listed.select("query_id", F.array_distinct(F.filter(F.flatten("found.forms"), lambda t: t != "")).alias("terms"))
    whole = F.array(F.coalesce(F.nullif(F.lower(T.normalize(F.col("text"))), F.lit("")), F.lit("x")))
    every = q.join(listed, "query_id", "left").select("query_id", F.when(F.size(F.coalesce("terms", F.array().cast("array<string>"))) > 0, F.col("terms")).otherwise(whole).alias("terms"))
    return every.select("query_id", F.posexplode(F.slice("terms", 1, cap)).alias("ix", "term")).select("query_id", "ix", F.filter(F.split("term", "\\s+"), lambda w: w != "").alias("words")).where("size(words) > 0")


def single(terms: DataFrame) -> DataFrame:
    """query_id, term of the terms of one word."""
    return terms.where("size(words) = 1").select("query_id", F.col("words")[0].alias("term"))


def phrases(terms: DataFrame) -> DataFrame:
    """query_id, ix, words of the terms of several words."""
    return terms.where("size(words) > 1").select("query_id", "ix", "words")
