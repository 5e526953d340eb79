"""Tokens of a public tokenizer, in Arrow batches."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

#: Where the ranks of a byte-level BPE are; a parameter of every operator that counts tokens.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that parts texts before merges. A fixed value of that tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space (as the pattern has it) that are too long for its matcher.
LONG_RUN = 10_000
_WHITE = r"\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"(?<![{_WHITE}])[{_WHITE}]{{{LONG_RUN},}}")


class Tokenizer:
    """Encodes texts; ``sizes[token]`` is a token's number of bytes."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._encode, self._encode_part = encoding.encode_ordinary, encoding._encode_single_piece
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def encode(self, text: str) -> list[int]:
        """The tokens of a whole text, however long.

        The pattern makes a run of white space one part, but for its last character
        where something follows. Long runs are parted here in that way.
        """
        out, at = [], 0
        for run in _RUN.finditer(text) if len(text) >= LONG_RUN else ():
            end = run.end() - (run.end() < len(text))
            out += self._encode(text[at : run.start()])
            out += self._encode_part(text[run.start() : end])
            at = end
        return out + self._encode(text[at:])

    def count(self, text: str | None) -> int:
        return len(self.encode(text)) if text else 0


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """One per worker process and file."""
    return Tokenizer(path)
