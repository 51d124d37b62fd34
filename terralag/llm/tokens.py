"""Byte-level BPE pieces inside tasks: texts cut where the tokenizer always cuts, pieces kept in a cache.

The pre-tokenizer's pattern (``' ?letters | ?digits | ?others |blanks``) always starts a match at a
space that is followed by a non-blank character, keeps no state and looks at most one character
ahead, which past such a cut is a blank as the end of a text is. So the parts between those spaces
can be encoded one by one and give the ids of the whole text.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np

#: Parts kept by a worker; later ones are encoded each time they come.
CACHE_PARTS = 400_000
SPECIAL = "<|endoftext|>"
_ODD = re.compile(r" \s")
_CUT = re.compile(r"(?= \S)")
_loaded: dict[str, object] = {}


def load(path: str):
    """The tokenizer of ``path``, once per worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            _loaded[path] = Tokenizer.from_file(path)
        else:
            import tiktoken
            from public_tokenizers import PATTERN

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            _loaded[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
    return _loaded[path]


def parts_of(text: str) -> list[str]:
    """The text's parts; all but the first have a leading space, which is left out."""
    if _ODD.search(text):
        first, *rest = _CUT.split(text)
        return [first, *(x[1:] for x in rest)]
    return text.split(" ")


class PartCache:
    """What ``encode(list of parts)`` gives for each part, for a slice of texts at a time."""

    def __init__(self, encode, limit: int = CACHE_PARTS):
        self.encode, self.limit, self.kept = encode, limit, {}

    def look_up(self, texts: list[str]) -> list[list]:
        """One list of values per text, in the order of its parts."""
        split = [parts_of(t) for t in texts]
        firsts = {p[0] for p in split if p[0]}
        heads = dict(zip(firsts, self.encode(list(firsts)), strict=True)) if firsts else {}
        new = list(set().union(*(p[1:] for p in split)).difference(self.kept))
        now = self.kept
        if new:
            values = self.encode([" " + x for x in new])
            if len(now) + len(new) > self.limit:
                now = _Two(now, dict(zip(new, values, strict=True)))
            else:
                now.update(zip(new, values, strict=True))
        get = now.__getitem__
        return [[*([heads[p[0]]] if p[0] else []), *map(get, p[1:])] for p in split]


class _Two(dict):
    """A dictionary with another one behind it."""

    def __init__(self, rest: dict, own: dict):
        super().__init__(own)
        self.rest = rest

    def __missing__(self, key):
        return self.rest[key]


def id_bytes(path: str):
    """Encoder of parts to little-endian 32-bit ids, for a rank file or a tokenizer file."""
    tokenizer = load(path)

    def ranks(parts):
        return [np.array(tokenizer.encode(x, allowed_special="all") if SPECIAL in x else tokenizer.encode_ordinary(x), "<u4").tobytes() for x in parts]

    def library(parts):
        return [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch(parts, add_special_tokens=False)]

    return library if path.endswith(".json") else ranks
