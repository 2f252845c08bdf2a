"""Token ids of a byte-level BPE vocabulary file, the same on every executor."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession

#: How byte-level BPE vocabularies of this kind cut a text before merging (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in such a file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def added(path: str) -> dict[str, int]:
    """The added tokens of a ``tokenizers`` JSON file and their ids: each is one id wherever it stands."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f).get("added_tokens", ())
    if odd := [t["content"] for t in tokens if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]:
        raise ValueError(f"added tokens that look at their neighbours are not supported: {odd}")
    return {t["content"]: t["id"] for t in tokens}


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a ``tokenizers`` JSON file; special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", ()) if t.get("special")}
    byte = _alphabet()
    return {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}


_BUILT: dict[str, object] = {}


def encoder(spark: SparkSession, path: str, markers: bool = False) -> Callable[[], Callable]:
    """A picklable function that gives, on an executor, text -> uint32 array of ids.

    The file is read here once and its ranks are broadcast (a vocabulary, so bounded by the
    file's size): executors need no copy of it.  Ids are those of the ``tokenizers`` library
    with ``add_special_tokens=False``; with ``markers`` the file's added tokens in a text are
    their own ids, as the library has them when the file is loaded, else ordinary text.
    """
    table, special = ranks(path), added(path) if markers else {}
    name = hashlib.sha256(repr((sorted(table.items()), sorted(special.items()))).encode()).hexdigest()
    sent = spark.sparkContext.broadcast(table)

    def get() -> Callable:
        from codicil.llm import tokens

        if name not in tokens._BUILT:
            import tiktoken

            tokens._BUILT[name] = tiktoken.Encoding("shared", pat_str=tokens.PATTERN, mergeable_ranks=sent.value, special_tokens=special)
        built = tokens._BUILT[name]

        def encode(text: str):
            try:
                return built.encode_to_numpy(text, allowed_special="all", disallowed_special=())
            except ValueError:  # its regular expressions can't backtrack over a very long run of spaces
                import numpy as np
                import regex

                one = built._core_bpe.encode_single_piece
                marks = "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True))
                out = []
                for part in regex.split(f"({marks})", text) if special else [text]:
                    if part in special:
                        out.append(special[part])
                    else:
                        out += [i for m in regex.finditer(tokens.PATTERN, part) for i in one(m[0].encode())]
                return np.array(out, dtype=np.uint32)

        return encode

    return get


def documents(batches, get: Callable[[], Callable], end_id: int) -> Iterator[tuple]:
    """(doc_id, uint32 ids with ``end_id`` at the end) for the rows (doc_id, text) of Arrow batches; null text is empty."""
    import numpy as np

    encode, end = get(), np.array([end_id], dtype="<u4")
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            text = text.as_py()
            yield doc_id.as_py(), np.concatenate([encode(text).astype("<u4", copy=False), end]) if text else end
