"""Token ids of whole texts, as the ``tokenizers`` library gives them, several times faster.

Byte-level BPE with ranked merges is run by ``tiktoken`` from the tokenizer's own file.
That gives the library's ids if (1) merged tokens are numbered in the order of their
merges, after all single symbols, and (2) each token, encoded alone, is one token: then
two neighbours whose concatenation is a token are always the pair that its merge names,
since a run of merges inside a span is the run on the span alone. Both are checked for
the whole vocabulary when a file is loaded; where they fail, and for texts with other
than common characters or with special strings, the library itself encodes.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: Patterns of the two kinds of tokenizer that are understood. Fixed values.
BYTE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZER = ["NFC", "Replace", "Lowercase"]
#: Letters beyond ASCII whose class, lower case and normal form nobody disputes, and punctuation.
LETTERS = "À-ÖØ-öø-įı-ſ"
OTHER = re.compile(f"[^\\x00-\\x7f{LETTERS}‐-‧‰-⁞¡§«°»¿]")
WORDS = re.compile(f"'(?:[stmd]|re|ve|ll)|[a-z{LETTERS}]+|[0-9]|[^ \\t-\\r0-9a-z{LETTERS}]+")
#: Longer texts are left to the library, whose patterns need no stack.
LONGEST = 1_000_000


def byte_symbols() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Apply the merges in order of rank, leftmost first."""
    while len(symbols) > 1:
        best = min(range(len(symbols) - 1), key=lambda i: (ranks.get((symbols[i], symbols[i + 1]), 1 << 60), i))
        if (symbols[best], symbols[best + 1]) not in ranks:
            break
        symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
    return symbols


class TextEncoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.words = self._kind(spec) == "word"
        self.ranked = self._ranked(spec) if self._kind(spec) else None

    @staticmethod
    def _kind(spec: dict) -> str | None:
        before, normal = spec["pre_tokenizer"] or {}, spec["normalizer"]
        if before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and normal is None:
            return "byte"
        steps = before.get("pretokenizers", [])
        if [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": WORD_PATTERN} and steps[0]["invert"] and not steps[1]["use_regex"] and [x["type"] for x in (normal or {}).get("normalizers", [])] == WORD_NORMALIZER:
            return "word"
        return None

    def _ranked(self, spec: dict):
        """The vocabulary as ranks of byte strings, if that is proved to be the same thing.

        A word's end is written as a line feed: white space is never part of a word.
        """
        import tiktoken

        model, symbols = spec["model"], byte_symbols()
        vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = [vocab[a + b] for a, b in merges]
        if ids != sorted(set(ids)) or (self.words != bool(self.suffix)) or model["ignore_merges"] or model["dropout"]:
            return None
        order = {m: i for i, m in enumerate(merges)}
        ranks = {}
        for token, n in vocab.items():
            final = bool(self.suffix) and token.endswith(self.suffix)
            body = token.removesuffix(self.suffix) if final else token
            parts = [*body[:-1], body[-1] + self.suffix] if final else list(body)
            if len(parts) > 1 and (merged(list(parts), order) != [token] or n < ids[0]):
                return None
            if len(parts) == 1 and n >= ids[0]:
                return None
            ranks[bytes(symbols[c] for c in body) + b"\n" * final] = n
        if len(ranks) != len(vocab):
            return None
        return tiktoken.Encoding("ranked", pat_str=r"[^\n]+\n" if self.words else BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """The ids of ``text`` without added special tokens, unsigned 32-bit."""
        if not text:
            return np.empty(0, np.uint32)
        if self.ranked is None or len(text) > LONGEST or any(s in text for s in self.special) or not (text.isascii() or not OTHER.search(text)):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if self.words:
            found = WORDS.findall(text.lower())
            if not found:
                return np.empty(0, np.uint32)
            text = "\n".join(found) + "\n"
        return self.ranked.encode_to_numpy(text, disallowed_special=())


@lru_cache(maxsize=4)
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)
