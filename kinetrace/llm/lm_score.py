"""Language-model scores by a weighted backoff automaton.

States are the contexts of the training n-grams.  An n-gram seen in training is
an arc from its context's state to the state of its longest suffix that is a
context; each state has a failure arc to the state of its context without the
first token, whose weight is what the context leaves to tokens not seen after
it.  Weights come from Dirichlet-smoothed counts,

    p(w | h) = (c(h w) + K p(w | h')) / (c(h) + K),

h' being h without its first token and K depending on the length of h, so that
log10 K / (c(h) + K) is the failure weight; the empty context has add-one counts
with one place for unknown tokens.  A text is scored by one traversal from left to
right that carries the state and adds up log probabilities.

No machine holds the whole automaton.  Rows are packed into blocks of a few
megabytes as they lie; a block asks for the counts of its own distinct n-grams,
which are summed over all blocks, and builds from the totals the states, arcs and
failure arcs that its traversals touch (``BlockAutomaton``).  Requests are parted
by the highest bits of the n-grams' hashes, into as many parts as there are
blocks but 2^``FAN_BITS`` at most.  Where there are more blocks than that, groups
of so many are merged first and ask, as one, a level further up: rows grow with
the n-grams, by one more pass for each factor 2^``FAN_BITS`` of blocks.  A frequent
n-gram is asked for once per block or group, so no key is hot.

All traversals of a block take their steps together, each with the state that it
carries.  Texts are cut into pieces of ``PIECE`` tokens; a piece begins with the
few tokens before it, after which it is in the state in which the piece before it ends.

Defined results: a null text counts as empty and is scored as the end alone;
words are runs of other bytes than ASCII white space, lower-cased A-Z, and the end
is a token; a null id counts as empty text in the split; texts of any length are
scored whole; repeated rows are scored, and learnt from, each; other columns are
never read, so their names may clash with any used here; without training rows
all tokens are unknown; an empty table gives no rows.  Words and n-grams are told
apart by 63-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, text_or_empty

#: Weights of the shorter context, for contexts of one token, of two, and so on; there is one order more.
STRENGTHS = (2000.0, 20.0)
#: Bytes of text in a block, highest bits by which requests are parted, tokens of a piece.
BLOCK_BYTES, FAN_BITS, PIECE = 8 << 20, 13, 128
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)

_REQUESTS = "sender long, path long, keys binary, counts binary"
_ANSWERS = "sender long, path long, totals binary, known long, tokens long"


def in_order(keys: np.ndarray) -> np.ndarray:
    """The places of 64-bit keys in the order of their upper half at least; the lower bits make room for the place."""
    bits = np.uint64(max(1, len(keys)).bit_length())
    packed = keys >> bits
    packed <<= bits
    packed |= np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    packed &= (np.uint64(1) << bits) - np.uint64(1)
    return packed.astype(index_type(len(keys)))


def index_type(size: int):
    """The type of places among ``size`` things: most of a block's memory are such."""
    return np.int32 if size < 1 << 31 else np.int64


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct of some numbers from 0 in order, and each value's place among them."""
    bits = len(values).bit_length()
    if not len(values) or int(values.max()).bit_length() + bits > 63:
        return np.unique(values, return_inverse=True)
    packed = values << bits  # sorting numbers is faster than sorting places
    packed |= np.arange(len(values))
    packed.sort()
    kind = index_type(len(values))
    place = (packed & ((1 << bits) - 1)).astype(kind)
    packed >>= bits
    first = np.concatenate([[True], packed[1:] != packed[:-1]])
    inverse = np.empty(len(values), kind)
    inverse[place] = np.cumsum(first, dtype=kind) - 1
    return packed[first], inverse


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text: how many, each one's place among the distinct ones, and the hashes of these."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    words = split.flatten()
    real = pc.not_equal(words, "")
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False), dtype=np.int64)])
    ends = split.offsets.to_numpy()
    n_words = np.diff(before[ends - ends[0]])
    del split, before
    words = words.filter(real)
    coded = words.dictionary_encode()
    del words
    hashes = np.array([*map(xxhash.xxh3_64_intdigest, coded.dictionary.to_numpy(zero_copy_only=False).tolist())], dtype=np.uint64)
    return n_words, coded.indices.to_numpy(), hashes


def _mix(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of their contexts and last words; both are used up."""
    before ^= before >> np.uint64(31)
    before *= np.uint64(0x9E3779B97F4A7C15)
    word *= np.uint64(0xBF58476D1CE4E5B9)
    before += word
    before ^= before >> np.uint64(29)
    before *= np.uint64(0x94D049BB133111EB)
    before ^= before >> np.uint64(32)
    return before


class BlockGrams:
    """The n-grams of a block's texts, as numbers from 0 for each length; words 0 and 1 are start and end."""

    def __init__(self, texts: pa.Array, order: int):
        n_words, indices, hashes = _split(texts)
        self.order, self.lengths = order, n_words + 1
        #: Where each text's start stands, and the word at every place.
        self.begins = np.cumsum(n_words + 2) - (n_words + 2)
        self.flat = np.empty(len(indices) + 2 * len(texts), dtype=np.int32)
        self.flat[self.begins], self.flat[self.begins + self.lengths] = 0, 1
        inner = np.ones(len(self.flat), bool)
        inner[self.begins] = inner[self.begins + self.lengths] = False
        self.flat[inner] = indices
        self.flat[inner] += 2
        del indices, inner
        pa.default_memory_pool().release_unused()
        words = mixed = np.concatenate([np.array([START, END], np.uint64), hashes])
        self.n_words = len(words)
        #: For each length: number, context, last word and longest suffix of the distinct n-grams; the n-gram that ends at each place, or -1.
        self.sizes, self.context, self.last, self.suffix, self.at = [len(words)], [None], [np.arange(len(words), dtype=np.int32)], [None], [self.flat]
        keys = [((words << np.uint64(1)) | np.uint64(1))[1:]]  # all but the start's
        for n in range(2, order + 1):
            whole = np.ones(len(self.flat), bool)
            for i in range(n - 1):
                whole[self.begins + np.minimum(i, self.lengths)] = False
            here = np.flatnonzero(whole).astype(index_type(len(whole)))
            values = self.at[-1][here - 1].astype(np.int64)
            values *= len(words)
            values += self.flat[here]
            pairs, inverse = distinct(values)
            del values, whole
            context = (pairs // len(words)).astype(self.at[-1].dtype)
            last = (pairs % len(words)).astype(np.int32)
            suffix = np.empty(len(pairs), self.at[-1].dtype)
            suffix[inverse] = self.at[-1][here]
            at = np.full(len(self.flat), -1, inverse.dtype)
            at[here] = inverse
            del pairs, inverse, here
            mixed = _mix(mixed[context], words[last])
            keys.append(mixed << np.uint64(1))  # even, those of words are odd
            self.sizes.append(len(mixed))
            self.context.append(context)
            self.last.append(last)
            self.suffix.append(suffix)
            self.at.append(at)
        del mixed
        #: The hashes of all n-grams but the start's, in order, and the places of the n-grams, shorter ones first, in it.
        keys = np.concatenate(keys)
        self.places = in_order(keys)
        self.keys = keys[self.places]

    def counts(self, training: np.ndarray) -> np.ndarray:
        """How often each of ``keys`` occurs in the training texts."""
        learnt = np.repeat(training, self.lengths + 1)
        by_length = [np.bincount(at[learnt & (at >= 0)], minlength=size) for at, size in zip(self.at, self.sizes, strict=True)]
        return np.concatenate(by_length)[1:][self.places].astype(np.uint64)

    def forget_keys(self) -> None:
        """Free what only requests and answers need."""
        self.keys = self.places = None

    def by_length(self, totals: np.ndarray) -> list[np.ndarray]:
        """Totals of ``keys`` as one array for each length."""
        out = np.zeros(len(totals) + 1, np.uint64)
        out[self.places + 1] = totals
        return np.split(out, np.cumsum(self.sizes)[:-1])


class BlockAutomaton:
    """States, arcs and failure arcs of the n-grams of a block, by their counts in all training texts.

    State 0 is the empty context.  Arcs are sorted by state and word.
    """

    def __init__(self, grams: BlockGrams, totals: list[np.ndarray], known: int, tokens: int, strengths: tuple[float, ...]):
        places = tokens + known + 1
        kind = index_type(sum(grams.sizes))
        self.unknown = -np.log10(places)

        def followed(n):
            """How often a token follows each context. The end has no follower, each training text has one start."""
            count = totals[n].astype(float)
            if n == 0:
                count[0] = totals[0][1]
            return count

        states, fails, weights, n_states = [], [np.zeros(1, kind)], [np.zeros(1)], 1
        for n in range(len(strengths)):
            count = followed(n)
            is_state = (count > 0) & (grams.last[n] != 1)
            shorter = states[-1][grams.suffix[n]] if n else np.zeros(len(count), kind)
            number = np.cumsum(is_state, dtype=kind)
            number += n_states - 1
            states.append(np.where(is_state, number, shorter))
            fails.append(shorter[is_state])
            weights.append(np.log10(strengths[n] / (count[is_state] + strengths[n])))
            n_states += len(fails[-1])
            del count, is_state, shorter, number
        self.fail, self.fail_weight = np.concatenate(fails), np.concatenate(weights)
        self.first = int(states[0][0]) if states else 0
        # N-grams are sorted by context and last word, and states numbered in that order: so are the arcs.
        arcs = sum(int(np.count_nonzero(count)) for count in totals)
        self.word, self.log, self.following = np.empty(arcs, np.int32), np.empty(arcs), np.empty(arcs, kind)
        degree, begin, p = np.zeros(n_states, kind), 0, (totals[0].astype(float) + 1) / places
        for n, count in enumerate(totals):
            if n:
                weight, context = strengths[n - 1], grams.context[n]
                p = p[grams.suffix[n]]
                p *= weight
                p += count
                p /= (followed(n - 1) + weight)[context]
            seen = np.flatnonzero(count).astype(kind)
            here, begin = slice(begin, begin + len(seen)), begin + len(seen)
            self.word[here] = grams.last[n][seen]
            self.log[here] = p[seen]
            if n:
                degree += np.bincount(states[n - 1][grams.context[n][seen]], minlength=n_states).astype(kind)
            else:
                degree[0] += len(seen)
            self.following[here] = states[n][seen] if n < len(states) else states[n - 1][grams.suffix[n][seen]] if n else 0
        np.log10(self.log, out=self.log)
        #: Where the arcs of each state begin.
        self.begin = np.concatenate([np.zeros(1, kind), np.cumsum(degree, dtype=kind)])
        self.grams = grams

    def arc(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The arc of each state by a word, or -1: bisection among the state's arcs."""
        out = np.full(len(state), -1, np.int64)
        low, high, open_ = self.begin[state], self.begin[state + 1], np.arange(len(state))
        while True:
            more = low < high
            low, high, open_, word = low[more], high[more], open_[more], word[more]
            if not len(open_):
                return out
            middle = (low + high) >> 1
            there = self.word[middle]
            hit = there == word
            out[open_[hit]] = middle[hit]
            low, high = np.where(there < word, middle + 1, low), np.where(there < word, high, np.where(hit, low, middle))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a word each, and its log probabilities."""
        total, after = np.zeros(len(state)), np.zeros(len(state), np.int64)
        open_ = np.arange(len(state))
        while len(open_):
            arc = self.arc(state, word)
            found = arc >= 0
            done, arc = open_[found], arc[found]
            total[done] += self.log[arc]
            after[done] = self.following[arc]
            total[open_[~found & (state == 0)]] += self.unknown
            on = ~found & (state > 0)
            open_, state, word = open_[on], state[on], word[on]
            total[open_] += self.fail_weight[state]
            state = self.fail[state]
        return after, total

    def scores(self, piece: int = PIECE) -> np.ndarray:
        """Log probability of each text."""
        g, memory = self.grams, self.grams.order - 1
        if not len(g.lengths):
            return np.array([])
        pieces = -(-g.lengths // piece)
        text = np.repeat(np.arange(len(pieces)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        warm = np.where(number > 0, min(memory, piece), 0)
        length = np.minimum(g.lengths[text] - number * piece, piece) + warm
        order = np.argsort(-length, kind="stable")
        text, number, warm, length = text[order], number[order], warm[order], length[order]
        at = g.begins[text] + 1 + number * piece - warm
        state, total = np.where(number > 0, 0, self.first), np.zeros(len(text))
        active = len(text)
        for i in range(int(length[0])):
            active = int(np.searchsorted(-length[:active], -i, side="left"))  # those longer than i
            state[:active], log = self.step(state[:active], g.flat[at[:active] + i])
            total[:active] += np.where(warm[:active] <= i, log, 0)
        return np.bincount(text, total, len(g.lengths))


def pack_keys(keys: np.ndarray) -> bytes:
    """Keys in order: the first upper half and the distances of the others, byte by byte, then the lower halves."""
    if not len(keys):
        return b""
    upper = keys >> np.uint64(32)
    steps = np.diff(upper)
    width = (int(steps.max()).bit_length() + 7) // 8 if len(steps) else 0
    planes = steps.view(np.uint8).reshape(-1, 8)[:, :width].T
    return np.array([len(keys), width], np.uint32).tobytes() + upper[:1].tobytes() + planes.tobytes() + keys.astype(np.uint32).tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    if not raw:
        return np.array([], dtype=np.uint64)
    size, width = np.frombuffer(raw, np.uint32, 2).astype(int)
    steps = np.zeros((size, 8), np.uint8)
    steps[1:, :width] = np.frombuffer(raw, np.uint8, (size - 1) * width, 16).reshape(width, size - 1).T
    steps = steps.view(np.uint64).ravel()
    steps[0] = np.frombuffer(raw, np.uint64, 1, 8)[0]
    return (np.cumsum(steps, dtype=np.uint64) << np.uint64(32)) | np.frombuffer(raw, np.uint32, size, 16 + (size - 1) * width)


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte per count, those of 255 and more in full behind them; compressed, as most are small."""
    large = counts[counts >= 255]
    return zstandard.compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + large.astype(np.uint64).tobytes(), 1)


def unpack_counts(raw: bytes, size: int) -> np.ndarray:
    raw = zstandard.decompress(raw)
    counts = np.frombuffer(raw, np.uint8, size).astype(np.uint64)
    counts[counts == 255] = np.frombuffer(raw, np.uint64, offset=size)
    return counts


def _bounds(keys: np.ndarray, used: int, bits: int) -> np.ndarray:
    """Where each part begins in sorted keys that agree in ``used`` bits; parts are the next ``bits`` bits."""
    part = (keys << np.uint64(used) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    return np.searchsorted(part, np.arange((1 << bits) + 1))


def _bits(senders: int, fan_bits: int) -> int:
    return min(fan_bits, max(0, senders - 1).bit_length())


def _blocks(batches, block_bytes: int):
    """(block, rows): rows (doc_id, held_out, text) as they lie in a task, of ``block_bytes`` of text; a task's blocks are the same whenever it runs."""
    block = TaskContext.get().partitionId() << 32
    held, size = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
        begin = 0
        for end, n in enumerate(sizes, 1):
            size += int(n)
            if size >= block_bytes:
                yield block, pa.Table.from_batches([*held, batch.slice(begin, end - begin)])
                block, begin, held, size = block + 1, end, [], 0
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield block, pa.Table.from_batches(held)


def pack_blocks(df: DataFrame, block_bytes: int) -> DataFrame:
    """(block, docs): blocks of rows, compressed."""

    def run(batches):
        for block, rows in _blocks(batches, block_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "docs"])

    return df.mapInArrow(run, "block long, docs binary")


def _unpacked(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def requests(df: DataFrame, block_bytes: int, order: int, bits: int) -> DataFrame:
    """Of each block, for each part of the hashes, its distinct n-grams and their training counts."""

    def run(batches):
        for block, rows in _blocks(batches, block_bytes):
            grams = BlockGrams(rows.column("text").combine_chunks(), order)
            yield _parts(block, 0, grams.keys, grams.counts(~rows.column("held_out").to_numpy()), 0, bits)

    return df.mapInArrow(run, _REQUESTS)


def _parts(sender: int, path: int, keys: np.ndarray, counts: np.ndarray, used: int, bits: int) -> pa.RecordBatch:
    """A row for each part, also where it is empty: all hear of the words and tokens that are known."""
    bounds = _bounds(keys, used, bits)
    pairs = [(a, b) for a, b in zip(bounds, bounds[1:], strict=False)]
    columns = [
        pa.array([sender] * len(pairs), pa.int64()),
        pa.array([(path << bits) + i for i in range(len(pairs))], pa.int64()),
        pa.array([pack_keys(keys[a:b]) for a, b in pairs], pa.binary()),
        pa.array([pack_counts(counts[a:b]) for a, b in pairs], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["sender", "path", "keys", "counts"])


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The senders' distinct keys, in no order, their summed counts, and each sender's places among them."""
    keys = [unpack_keys(k.as_py()) for k in table.column("keys")]
    ends = np.cumsum([len(k) for k in keys])[:-1]
    keys = np.concatenate(keys)
    counts = np.empty(len(keys))
    for part, raw in zip(np.split(counts, ends), table.column("counts"), strict=True):
        part[:] = unpack_counts(raw.as_py(), len(part))
    inverse, merged = pd.factorize(keys)
    del keys
    totals = np.bincount(inverse, counts, len(merged)).astype(np.uint64)
    return merged, totals, np.split(inverse, ends)


def _answers(table: pa.Table, totals: np.ndarray, places: list[np.ndarray], known: int, tokens: int) -> pa.Table:
    rows = len(table)
    return pa.table(
        {
            "sender": table.column("sender"),
            "path": table.column("path"),
            "totals": pa.array([pack_counts(totals[p]) for p in places], pa.binary()),
            "known": pa.array([known] * rows, pa.int64()),
            "tokens": pa.array([tokens] * rows, pa.int64()),
        }
    )


def _answer(table: pa.Table) -> pa.Table:
    """Totals for all senders of a part, and its known words and tokens."""
    keys, totals, places = _merged(table)
    words = keys & np.uint64(1) == 1
    return _answers(table, totals, places, int((totals[words] > 0).sum()), int(totals[words].sum()))


def exchange(asked: DataFrame, senders: int, fan_bits: int, used: int) -> DataFrame:
    """Answers to requests whose keys are parted by ``used`` bits so far."""
    groups = -(-senders >> fan_bits) if senders else 1
    if groups <= 1:
        return asked.groupBy("path").applyInArrow(_answer, _ANSWERS)
    bits = _bits(groups, fan_bits)

    def merge(key, table):
        keys, totals, _ = _merged(table)
        order = in_order(keys)
        return pa.Table.from_batches([_parts(key[0].as_py(), key[1].as_py(), keys[order], totals[order], used, bits)])

    def hand_down(table, above):
        keys, _, places = _merged(table)
        order = in_order(keys)
        bounds, totals = _bounds(keys[order], used, bits), np.zeros(len(keys), np.uint64)
        for part, raw in zip(above.column("part").to_pylist(), above.column("totals").to_pylist(), strict=True):
            a, b = bounds[part], bounds[part + 1]
            totals[order[a:b]] = unpack_counts(raw, b - a)
        known, tokens = (int(pc.sum(above.column(c)).as_py()) for c in ("known", "tokens"))
        return _answers(table, totals, places, known, tokens)

    placed = asked.withColumn("group", F.pmod(F.xxhash64("sender"), F.lit(groups)))
    above = exchange(placed.groupBy("group", "path").applyInArrow(merge, _REQUESTS), groups, fan_bits, used + bits)
    above = above.select(
        F.col("sender").alias("group"), F.shiftright("path", bits).alias("path"), F.pmod("path", F.lit(1 << bits)).alias("part"), "totals", "known", "tokens"
    )
    return placed.groupBy("group", "path").cogroup(above.groupBy("group", "path")).applyInArrow(hand_down, _ANSWERS)


def lm_scores(
    df: DataFrame,
    held_out,
    strengths: tuple[float, ...] = STRENGTHS,
    block_bytes: int = BLOCK_BYTES,
    fan_bits: int = FAN_BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    The model learns from the rows where ``held_out`` is false; its n-grams have
    up to one token more than there are ``strengths``.
    """
    order, text = len(strengths) + 1, text_or_empty(text_col)
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    senders = max(1, -(-size // block_bytes))
    bits = _bits(senders, fan_bits)
    rows = df.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), text.alias("text"))
    blocks = pack_blocks(rows, block_bytes)
    answered = exchange(requests(rows, block_bytes, order, bits), senders, fan_bits, bits)
    kind = df.schema[id_col].dataType.simpleString()

    def run(packed, answers):
        docs = _unpacked(packed.column("docs")[0].as_py())
        grams = BlockGrams(docs.column("text").combine_chunks(), order)
        docs = docs.drop_columns("text")
        bounds, totals = _bounds(grams.keys, 0, bits), np.zeros(len(grams.keys), np.uint64)
        for path, raw in zip(answers.column("path").to_pylist(), answers.column("totals"), strict=True):
            a, b = bounds[path], bounds[path + 1]
            totals[a:b] = unpack_counts(raw.as_py(), b - a)
        known, tokens = (int(pc.sum(answers.column(c)).as_py()) for c in ("known", "tokens"))
        totals = grams.by_length(totals)
        grams.forget_keys()
        document = np.repeat(np.arange(len(grams.lengths)), grams.lengths)
        count = totals[0][np.delete(grams.flat, grams.begins)].astype(float)
        score = BlockAutomaton(grams, totals, known, tokens, strengths).scores()
        n = len(grams.lengths)
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "held_out": docs.column("held_out"),
                "n_tokens": pa.array(grams.lengths, pa.int64()),
                "n_known": pa.array(np.bincount(document, count > 0, n).astype(np.int64), pa.int64()),
                "train_tokens": pa.array(np.full(n, tokens), pa.int64()),
                "base_score": pa.array(np.bincount(document, np.log10((count + 1) / (tokens + known + 1)), n), pa.float64()),
                "score": pa.array(score, pa.float64()),
            }
        )

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    answered = answered.withColumnRenamed("sender", "block")
    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(run, schema)


def score_documents(df: DataFrame, modulus: int = 7, held_out: int = 2, **options) -> DataFrame:
    """Scores of all rows by a model of the rows that are not held out."""
    return lm_scores(df, id_remainder(modulus) == held_out, **options)
