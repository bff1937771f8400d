"""Token counts at every prefix by dynamic programming.

For a match of the pattern, the encoding of a prefix that ends at byte i is the
encoding of a shorter prefix plus one last token: the only token that ends at i
and that byte-pair encoding leaves apart from the token before it.  Going from
left to right, the last token and with it the exact count of every prefix follow
from the shorter ones.  Matches return again and again, so their tables are
kept, and a text's counts are the running sum over its matches.

``PrefixCounts.counts`` answers how many tokens any prefix of a text has,
``truncate`` how much of it fits a budget, without encoding again; the rows of
``token_counts`` say how many bytes of a text fit the limit.

Defined results: a null text counts as empty, with no tokens; the special token's
string inside a text is one token, as in the library's default; a text of any
length is read whole; other columns may have any name; repeated rows are counted each; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty
from .pieces import PartCache, byte_alphabet

#: Prefixes of matches up to this many bytes are remembered; longer matches take the same steps in arrays of their own.
REMEMBERED = 200
#: Entries of a worker's tables; a table is emptied beyond them.
ENTRIES = 1_000_000


class PrefixCounts:
    """Exact counts of a tokenizer file with byte-level BPE."""

    def __init__(self, tokenizer_file: str, pattern: str, special: tuple[str, ...] = ("<|endoftext|>",)):
        with open(tokenizer_file, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = byte_alphabet()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: Pair of tokens -> rank of their merge.
        self.ranks = {tuple(bytes(letters[c] for c in t) for t in pair): rank for rank, pair in enumerate(pairs)}
        self.tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in self.ranks}
        self.tokens = {t for t in self.tokens if self.merge(t) == [t]}
        self.longest_token = max(map(len, self.tokens))
        self.endings = {t[i:] for t in self.tokens for i in range(len(t))}
        self.match = regex.compile(pattern)
        self.space = regex.compile(r"\s+")
        self.special = special
        self.special_match = regex.compile("|".join(map(regex.escape, special)) or r"(?!)")
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        #: Prefix of a match -> its tokens, and the last of them.
        self.states: dict[bytes, tuple[int, bytes]] = {b"": (0, b"")}

    def merge(self, piece: bytes) -> list[bytes]:
        """Byte-pair encoding of a short piece, lowest rank first."""
        get, none = self.ranks.get, 1 << 60
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = [get(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        while ranks and (rank := min(ranks)) != none:
            at = ranks.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get((parts[at - 1], parts[at]), none)
            if at < len(ranks):
                ranks[at] = get((parts[at], parts[at + 1]), none)
        return parts

    def stays_apart(self, pair: tuple[bytes, bytes]) -> bool:
        """Whether two tokens side by side are encoded as these two."""
        if len(self.apart) > ENTRIES:
            self.apart.clear()
        found = self.apart[pair] = self.merge(pair[0] + pair[1]) == list(pair)
        return found

    def last(self, piece: bytes) -> tuple[int, bytes]:
        """Tokens of a match's first bytes, and the last of them.

        Begins at the longest prefix that is known, from whatever word.
        """
        states = self.states
        found = states.get(piece)
        if found is not None:
            return found
        if len(states) > ENTRIES:
            states.clear()
            states[b""] = 0, b""
        known = len(piece) - 1
        while piece[:known] not in states:
            known -= 1
        tokens, apart, longest = self.tokens, self.apart, self.longest_token
        for end in range(known + 1, len(piece) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = piece[start:end]
                if token in tokens:
                    count, before = states[piece[:start]]
                    if start:
                        pair = before, token
                        fits = apart.get(pair)
                        if not (self.stays_apart(pair) if fits is None else fits):
                            continue
                    found = states[piece[:end]] = count + 1, token
                    break
        return found

    def table(self, piece: bytes) -> list[int]:
        """table[i]: tokens of the first i bytes of a match of any length.

        Time and memory grow with the length: for each end, tokens that end there
        are tried from the shortest on, as long as some token has such an ending.
        """
        tokens, endings, apart = self.tokens, self.endings, self.apart
        counts, last = [0] * (len(piece) + 1), [b""] * (len(piece) + 1)
        for end in range(1, len(piece) + 1):
            start = end
            while start and (token := piece[start - 1 : end]) in endings:
                start -= 1
                if token not in tokens:
                    continue
                if start:
                    pair = last[start], token
                    fits = apart.get(pair)
                    if not (self.stays_apart(pair) if fits is None else fits):
                        continue
                counts[end], last[end] = counts[start] + 1, token
                break
        return counts

    def match_total(self, match: str) -> int:
        raw = match.encode()
        return self.last(raw)[0] if len(raw) <= REMEMBERED else self.table(raw)[-1]

    def total(self, text: str) -> int:
        """Tokens of a text: the last entry of its counts."""
        parts = self.special_match.split(text) if any(s in text for s in self.special) else [text]
        return sum(self.match_total(m) for part in parts for m in self.match.findall(part)) + len(parts) - 1

    def part_totals(self, parts: list[str]) -> list[int]:
        """Totals of parts between safe cuts; plain words need no pattern."""
        last, out = self.last, []
        for part in parts:
            word = part[1:]
            if word.isalpha() and part[0] == " " and len(part) < 200:
                out.append(last(part.encode())[0])
            elif word[-1:] in (".", ",") and word[:-1].isalpha() and part[0] == " " and len(part) < 200:
                out.append(last(part[:-1].encode())[0] + 1)
            else:
                out.append(self.total(part))
        return out

    def counts(self, text: str) -> np.ndarray:
        """counts[i]: tokens of ``text[:i]`` as the library encodes that prefix."""
        out = np.zeros(len(text) + 1, dtype=np.int64)
        at = 0
        for m in self.special_match.finditer(text):
            self._fill(text[at : m.start()], at, out)
            for i in range(m.start() + 1, m.end()):  # a special string that is cut is ordinary text
                out[i] = (out[at] if at else 0) + self.total(text[at:i])
            out[m.end()] = out[m.start()] + 1
            at = m.end()
        self._fill(text[at:], at, out)
        return out

    def _fill(self, text: str, at: int, out: np.ndarray) -> None:
        """Counts of a text without special strings that begins at ``at``."""
        base, run_end = int(out[at]), None
        for m in self.match.finditer(text):
            match, begin, end = m.group(), at + m.start(), at + m.end()
            raw = match.encode()
            inner = np.asarray(self.table(raw))[np.cumsum([len(c.encode()) for c in match])]
            out[begin + 1 : end + 1] = base + np.asarray(inner)
            if match[0] == "'" and match[1:] in ("re", "ve", "ll"):  # after one letter it is no contraction
                out[begin + 2] = base + 2
            if run_end:
                out[run_end[0]] = run_end[1]
                run_end = None
            # The last character of white space goes to what follows; where the prefix ends there, it does not.
            if m.end() < len(text) and self.space.fullmatch(match) and self.space.match(text[m.end()]):
                run_end = end + 1, base + self.match_total(match + text[m.end()])
            base += int(inner[-1])
        if run_end:
            out[run_end[0]] = run_end[1]

    def truncate(self, text: str, budget: int, counts: np.ndarray | None = None) -> str:
        """The longest prefix of at most ``budget`` tokens."""
        counts = self.counts(text) if counts is None else counts
        return text[: int(np.flatnonzero(counts <= budget)[-1])]


@lru_cache(maxsize=2)
def prefix_counts(tokenizer_file: str, pattern: str) -> PrefixCounts:
    return PrefixCounts(tokenizer_file, pattern)


@lru_cache(maxsize=2)
def part_totals(tokenizer_file: str, pattern: str) -> PartCache:
    """Totals of the parts between safe cuts; a worker keeps them for its next task."""
    table = prefix_counts(tokenizer_file, pattern)
    return PartCache(table.part_totals)


def bytes_within(head: str, rest: list[str], totals: list[int], limit: int, table: PrefixCounts) -> int:
    """Bytes of the longest prefix of at most ``limit`` tokens, of a text that has more, from its parts and their totals.

    Only the part in which the limit is passed needs the counts of its prefixes.
    """
    before = 0
    for k, upto in enumerate(itertools.accumulate(totals)):
        if upto > limit:
            break
        before = upto
    part = f" {rest[k - 1]}" if k else head
    begin = len(" ".join([head, *rest[: k - 1]]).encode()) if k else 0
    inner = np.flatnonzero(table.counts(part) <= limit - before)[-1]
    return begin + len(part[: int(inner)].encode())


def token_counts(df: DataFrame, tokenizer_file: str, pattern: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and keep_bytes (of the longest prefix within the limit) of each row, in one pass."""
    def run(batches):
        parts, table = part_totals(tokenizer_file, pattern), prefix_counts(tokenizer_file, pattern)
        for batch in slices(batches):
            n, size, keep = [], [], []
            for text in batch.column(1).to_pylist():
                head, rest, totals = parts.parts_of(text)
                n.append(sum(totals))
                size.append(len(text.encode()))
                keep.append(bytes_within(head, rest, totals, limit, table) if n[-1] > limit else size[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(keep, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "keep_bytes"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), text_or_empty(text_col)).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, keep_bytes long")


def prefix_table(df: DataFrame, tokenizer_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts): tokens of every prefix, by characters; to be stored beside the texts."""
    def run(batches):
        table = prefix_counts(tokenizer_file, pattern)
        for batch in slices(batches):
            counts = [table.counts(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "counts"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), text_or_empty(text_col)).mapInArrow(run, f"doc_id {kind}, counts array<long>")


def fits(table: DataFrame, budget: int) -> DataFrame:
    """(doc_id, keep_chars): characters of the longest prefix within the budget, from stored counts."""
    within = F.expr(f"array_max(transform(counts, (c, i) -> if(c <= {int(budget)}, i, 0)))")
    return table.select("doc_id", within.cast("long").alias("keep_chars"))
