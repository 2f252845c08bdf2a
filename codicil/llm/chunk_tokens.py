"""Token ids of a ``tokenizers`` BPE file that drops white space and marks word ends; each distinct chunk of text is encoded once."""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable

from pyspark.sql import SparkSession

from .tokens import _alphabet

#: Distinct chunks that a Python worker remembers; at that number it begins anew.
MOST_CHUNKS = 600_000
#: Characters of unseen chunks that the library encodes in one call, about.
CALL_CHARS = 1 << 14
#: Bytes of text handled at once; a longer text is handled alone.
TEXT_BYTES = 1 << 22
#: What such a file does before merging (fixed values).
STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that NFC leaves alone and whose lower case and kind every Unicode version has alike.
PLAIN = "[\x21-\x7e\u00a1-\u012f\u0131-\u024f\u0400-\u045f]+"

_BUILT: dict[str, tuple] = {}


def _ranks(spec: dict) -> dict[bytes, int]:
    """Token bytes to id, a word's end written as a zero byte; ids are merge ranks where the file is as expected."""
    split, level = spec["pre_tokenizer"]["pretokenizers"]
    as_known = spec["normalizer"]["normalizers"] == STEPS and split["pattern"] == {"Regex": PATTERN} and split["behavior"] == "Removed" and split["invert"]
    model = spec["model"]
    if not as_known or level["type"] != "ByteLevel" or level["add_prefix_space"] or level["use_regex"] or model["end_of_word_suffix"] != "</w>" or any(c.isspace() for t in spec["added_tokens"] for c in t["content"]):
        raise ValueError("chunk_encoder needs a byte-level BPE file with word ends that lower-cases and drops white space")
    byte = _alphabet()
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    if ids != sorted(ids) or ids[0] != len(model["vocab"]) - len(ids):
        raise ValueError("ids of merged tokens must be in the order of the merges")
    return {bytes(byte[c] for c in t.removesuffix("</w>")) + b"\0" * t.endswith("</w>"): i for t, i in model["vocab"].items()}


def chunk_encoder(spark: SparkSession, path: str) -> Callable[[], Callable]:
    """A picklable function that gives, on an executor, a string column -> runs of (first row, ids, ends of the rows).

    A text's ids are those of the chunks between its ASCII white space, one after another, as
    the library's own with ``add_special_tokens=False`` (added tokens in a text are their own
    ids).  The file is broadcast (a vocabulary, bounded by its size), so executors need no copy.
    A worker encodes a chunk once: chunks of ``PLAIN`` characters by their pieces and the merge
    ranks, all others by ``tokenizers`` itself.  Null is like empty.
    """
    with open(path, encoding="utf-8") as f:
        text = f.read()
    ranks = _ranks(json.loads(text))
    name, sent = hashlib.sha256(text.encode()).hexdigest(), spark.sparkContext.broadcast((text, ranks))

    def get() -> Callable:
        from codicil.llm import chunk_tokens as own

        if name not in own._BUILT:
            own._BUILT[name] = own._Chunks(*sent.value)
        return own._BUILT[name].encode

    return get


class _Chunks:
    def __init__(self, text: str, ranks: dict[bytes, int]):
        import os

        import regex
        import tiktoken

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(text)
        self.merge = tiktoken.Encoding("chunks", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.pieces, self.plain = regex.compile(PATTERN).findall, regex.compile(PLAIN).fullmatch
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def learn(self, chunks: list[str]) -> None:
        import numpy as np

        words, odd = self.words, []
        for c in chunks:
            if c.isascii() and c.isalpha():
                pieces = (c.lower(),)
            elif self.plain(c) and "<|" not in c:
                pieces = self.pieces(c.lower())
            else:
                odd.append(c)
                continue
            ids = []
            for p in pieces:
                if (found := words.get(p)) is None:
                    found = words[p] = array("I", self.merge(p.encode() + b"\0")).tobytes()
                ids.append(found)
            self.chunks[c] = b"".join(ids)
        at = 0
        while at < len(odd):  # lines of one text, told apart by their places
            to, size = at, 0
            while to < len(odd) and (to == at or size < CALL_CHARS):
                size += len(odd[to]) + 1
                to += 1
            some = odd[at:to]
            found = self.library.encode("\n".join(some), add_special_tokens=False)
            edges = np.searchsorted(np.array([o[0] for o in found.offsets], dtype=np.int64), np.cumsum([0, *(len(c) + 1 for c in some)]))
            raw = np.array(found.ids, dtype="<u4").tobytes()
            self.chunks |= {c: raw[4 * edges[k] : 4 * edges[k + 1]] for k, c in enumerate(some)}
            at = to

    def encode(self, column):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        column = column.cast(pa.large_string()).fill_null("")
        size = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(column):
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + TEXT_BYTES, side="right")))
            lists = pc.ascii_split_whitespace(column.slice(at, to - at))
            chunks = lists.flatten().dictionary_encode()
            distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
            if len(self.chunks) > MOST_CHUNKS:
                self.chunks.clear()
            if len(self.words) > MOST_CHUNKS:
                self.words.clear()
            self.chunks[""] = b""
            parts = list(map(self.chunks.get, distinct))
            if None in parts:
                self.learn([c for c, p in zip(distinct, parts) if p is None])
                parts = list(map(self.chunks.get, distinct))
            n = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
            flat, starts = np.frombuffer(b"".join(parts), dtype="<u4"), np.cumsum(n) - n
            code = chunks.indices.to_numpy()
            each = n[code]
            ends = np.cumsum(each)
            ids = flat[np.repeat(starts[code] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)]
            bounds = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            yield at, ids, np.concatenate([[0], ends])[bounds]
            at = to
