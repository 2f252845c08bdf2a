import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return WORDS.findall(text)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def edited(text, k, seed):
    r, w = random.Random(seed), text.split(" ")
    for i in r.sample(range(len(w)), k):
        w[i] = f"new{r.randint(0, 10**6)}"
    return " ".join(w)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank string"


def documents(spark, texts, ids=None, langs=None, sources=None):
    """documents with one more column whose name clashes with columns that operators add."""
    ids = ids or list(range(len(texts)))
    rows = [(i, t, (langs or ["en"])[k % len(langs or ["en"])], (sources or ["s"])[k % len(sources or ["s"])], len(t or ""), "x") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS)
