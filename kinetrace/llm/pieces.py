"""Tokenizers and cached values of the parts between safe cuts.

A single space between two characters that are no white space starts a match of
the byte-level BPE pattern, so text between two such places is encoded alike
wherever it stands.  Most such parts are words that return again and again: they
are looked up, and only new ones are computed, many at a time.
"""

from __future__ import annotations

import re
from functools import lru_cache

SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Entries of a worker's cache, which is emptied beyond them; longest part that is kept.
CACHE, LONGEST_KEPT = 500_000, 64


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PartCache:
    """Values of a text's parts, in order.

    ``values(parts)`` gives a value for each of a list of new parts, which carry
    their leading space.
    """

    def __init__(self, values, entries: int = CACHE):
        self.values, self.entries, self.kept = values, entries, {}

    def of(self, text: str) -> list:
        return self.parts_of(text)[2]

    def parts_of(self, text: str) -> tuple[str, list[str], list]:
        """The first part, the others without their leading space, and the values of all."""
        if not text:
            return "", [], []
        head, *rest = text.split(" ")
        kept = self.kept
        found = list(map(kept.get, rest))
        new = [p for p, f in zip(rest, found, strict=True) if f is None]
        if new or not head or head[-1].isspace():
            if not head or head[-1].isspace() or any(not p or p[0].isspace() or p[-1].isspace() for p in new):
                head, *rest = SAFE_CUT.split(text)  # runs of white space: cut only where that is safe
                found = list(map(kept.get, rest))
                new = [p for p, f in zip(rest, found, strict=True) if f is None]
            if len(kept) + len(new) > self.entries:
                kept.clear()
            fresh = dict(zip(new, self.values([" " + p for p in new]), strict=True))
            found = [fresh[p] if f is None else f for p, f in zip(rest, found, strict=True)]
            kept.update((p, v) for p, v in fresh.items() if len(p) <= LONGEST_KEPT and not p[-1].isspace())
        return head, rest, [*self.values([head]), *found]


def id_type(path: str) -> str:
    """Little-endian unsigned integers that hold the vocabulary's ids."""
    return "<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"


@lru_cache(maxsize=2)
def fast_encoder(path: str, pattern: str):
    """The ids that the tokenizers library gives for ``path``, by a faster merge loop.

    A byte-level file whose ids follow the order of its merges is a rank file;
    tiktoken then gives the same ids about six times as fast.  Any other file is
    refused.  The file's special tokens are found in texts, as is the default.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = byte_alphabet()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocabulary = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    ids = [spec["model"]["vocab"][a + b] for a, b in pairs]
    if ids != sorted(ids) or len(vocabulary) != 256 + len(ids):
        raise ValueError(f"the ids of {path} do not follow its merges")
    encoder = tiktoken.Encoding("by_merges", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens=special)
    return lambda text: encoder.encode_to_numpy(text, allowed_special="all")
