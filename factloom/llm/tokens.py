"""Byte-level BPE ids of whole texts, from a vocabulary file whose path is a parameter.

The tokenizer's pattern looks ahead at the end of white space, step by step, and breaks down in runs of about a
million. The pieces that it would make of a run of RUN and more are known: all of it at the end of a text, else all
but its last character, which goes with what follows. So long runs are cut there and encoded as the piece they are.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY):
    """The tokenizer and the number of bytes of each of its ids."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int32)
    for token, i in ranks.items():
        size[i] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


RUN = 10_000
_LONG = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN)  # white space as the tokenizer knows it


def _ids(e, text: str) -> list[int]:
    if len(text) < RUN:
        return e.encode_ordinary(text)
    out, at = [], 0
    for m in _LONG.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += e.encode_ordinary(text[at : m.start()])
        out += e._encode_single_piece(text[m.start() : end])
        at = end
    return out + e.encode_ordinary(text[at:])


def encode(texts: list[str | None], path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and the n + 1 places where each one's begin; null as empty."""
    e = encoding(path)[0]
    parts = [np.array(_ids(e, t), np.uint32) if t else np.zeros(0, np.uint32) for t in texts]
    return np.concatenate([np.zeros(0, np.uint32), *parts]), np.cumsum([0, *map(len, parts)])
