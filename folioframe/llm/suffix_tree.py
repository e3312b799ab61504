"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are all words and the end of a text; contexts are all sequences of up to ``depth``
words. The only minimum is absolute: a context counts from ``LEAST`` occurrences on, and so
does a successor of one (those seen less often are pooled as new there; they still count
towards the context's total and number of successors). So the tree grows with the corpus.

It grows a level at a time. A context is retained if the divergence of its next-symbol
distribution from that of its longest suffix, weighted by its count, exceeds what its
distinct successors would cost by chance (a penalised likelihood-ratio test).
Distributions are smoothed towards the suffix's (Witten-Bell), down to the base model. A
token is scored by the longest retained suffix of what stands before it.

N-grams are counted in packed blocks. An n-gram can only come ``LEAST`` times if the one
without its first and the one without its last word do, so bitmaps of those of the level
below (2^27 bits at most) spare most of the others; they never decide a result. Blocks are
sharded by the n-gram's suffix, so that the probability to back off to lies in the same
shard; it goes there as a table. Suffixes with a share of 1/4,096 of all tokens, of which
there are 4,096 at most, would make a shard hot: their n-grams are spread out instead and
their probabilities are broadcast. A context's total is its own count one level below.
The n-grams that count then go, in blocks, to their contexts' shards, where contexts are
judged; those of hot contexts are spread out again, and what each shard has of their sums
is added up first.

A token's log probability is the base's plus, for each n-gram that ends there, a value of
that n-gram: its gain over backing off if its context is retained, and its own back-off
weight (what follows it pays that, and something always follows words). So documents join
with the tree and the base model at once, in packed blocks (see ``blocks``).

The base model counts every word of every training text, sharded by word.

Defined results: a null text is an empty one, which has its end as the only token; a null
id is not learned from and not held out; repeated rows give repeated results, and rows of
one id with unlike texts are scored each by its own text; without training rows all scores
are 0 (the one probability is 1); an empty table gives an empty result. Texts of any length
are read whole. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.blocks import (
    TABLE,
    bitmap,
    counted,
    in_bitmap,
    join_blocks,
    meet,
    named,
    pack_arrays,
    pack_blocks,
    payloads,
    shard_bits,
    sharded,
    unpack_arrays,
)
from folioframe.llm.scratch import Scratch, cut
from folioframe.llm.textblocks import Words, as_long, chunks, mix

LEAST = 2  # occurrences of a context, and of a successor that has a probability of its own there
END = np.uint64(0x5851F42D4C957F2D)  # stands for the end of a text
_BASE = np.uint64(0xD1342543DE82EF95)
HOT = 4096  # a suffix with this part of all tokens has its n-grams spread over all shards
TURNS = 2  # in which documents are scored, so that the files of one go before the next
_GATHERED = 4_000_000  # n-grams held before equal ones are added up
_MOST_BITS = 27  # of a bitmap's size
_BITS = np.uint64(16)  # of a symbol in a packed context


@dataclass
class Tree:
    """The tree of a small vocabulary in memory, next to which tests hold the tables below.

    Retained contexts by length: packed symbols, parents and smoothed next-symbol entries.
    """

    words: np.ndarray  # sorted hashes; symbol i is words[i]; then the class of others, then the end
    base: np.ndarray  # probability of each symbol without context
    contexts: list[np.ndarray] = field(default_factory=list)  # by length: sorted packed contexts
    states: list[np.ndarray] = field(default_factory=list)  # their state numbers; 0 is the root
    parent: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    backoff: np.ndarray = field(default_factory=lambda: np.zeros(1))
    entries: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # state << 16 | symbol, sorted
    chance: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def other(self) -> int:
        return len(self.words)

    @property
    def end(self) -> int:
        return len(self.words) + 1

    def symbols(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of a chunk with the end after each text, and how far back its text goes."""
        found = lookup(self.words, words.hashes)
        inner = np.where(found < 0, self.other, found)
        sizes = np.diff(words.offsets) + 1
        stops = np.cumsum(sizes) - 1
        out = np.full(int(sizes.sum()), self.end, np.int64)
        body = np.ones(len(out), bool)
        body[stops] = False
        out[body] = inner
        return out, np.arange(len(out)) - np.repeat(stops + 1 - sizes, sizes)

    def packed(self, symbols: np.ndarray, depth: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``length`` symbols before each position, and whether they are there and all frequent words."""
        key = np.zeros(len(symbols), np.uint64)
        good = depth >= length
        for j in range(length, 0, -1):
            before = np.zeros(len(symbols), np.int64)
            before[j:] = symbols[:-j]
            good &= before < self.other
            key = (key << _BITS) | before.astype(np.uint64)
        return key, good

    def state(self, symbols: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The longest retained suffix at each position."""
        out = np.zeros(len(symbols), np.int64)
        for length, (known, states) in enumerate(zip(self.contexts, self.states, strict=True), 1):
            if len(known):
                key, good = self.packed(symbols, depth, length)
                at = lookup(known, key)
                hit = good & (at >= 0)
                out[hit] = states[at[hit]]
        return out

    def probability(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        out, weight, active = np.zeros(len(state)), np.ones(len(state)), np.arange(len(state))
        state = state.copy()
        while len(active):
            root = state[active] == 0
            done = active[root]
            out[done] = weight[done] * self.base[symbol[done]]
            active = active[~root]
            key = (state[active].astype(np.uint64) << _BITS) | symbol[active].astype(np.uint64)
            at = lookup(self.entries, key)
            hit = at >= 0
            out[active[hit]] = weight[active[hit]] * self.chance[at[hit]]
            active = active[~hit]
            weight[active] *= self.backoff[state[active]]
            state[active] = self.parent[state[active]]
        return out

    def grow(self, length: int, contexts: np.ndarray, context: np.ndarray, symbol: np.ndarray, count: np.ndarray) -> None:
        """Retain contexts of this length. The last three arrays list next-symbol counts by context number."""
        if not len(context):
            self.contexts.append(np.zeros(0, np.uint64))
            self.states.append(np.zeros(0, np.int64))
            return
        parents = np.zeros(len(contexts), np.int64)
        suffix = contexts & np.uint64((1 << (16 * (length - 1))) - 1)
        for shorter in range(1, length):
            key = suffix & np.uint64((1 << (16 * shorter)) - 1)
            at = lookup(self.contexts[shorter - 1], key)
            parents = np.where(at >= 0, self.states[shorter - 1][at], parents)
        total = np.bincount(context, count, len(contexts))
        kinds = np.bincount(context, minlength=len(contexts))
        above = self.probability(parents[context], symbol)
        gain = np.bincount(context, count * np.log(count / total[context] / above), len(contexts))
        keep = np.flatnonzero((total > 0) & (gain > 0.5 * kinds * np.log(np.maximum(total, 2))))
        number = np.full(len(contexts), -1, np.int64)
        number[keep] = len(self.parent) + np.arange(len(keep))
        self.contexts.append(contexts[keep])
        self.states.append(number[keep])
        self.parent = np.append(self.parent, parents[keep])
        self.backoff = np.append(self.backoff, (kinds[keep] / (total + kinds)[keep]))
        kept = number[context] >= 0
        c, s = context[kept], symbol[kept]
        entries = (number[c].astype(np.uint64) << _BITS) | s.astype(np.uint64)
        chance = (count[kept] + kinds[c] * above[kept]) / (total + kinds)[c]
        entries, chance = np.append(self.entries, entries), np.append(self.chance, chance)
        order = np.argsort(entries)
        self.entries, self.chance = entries[order], chance[order]


def lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of ``keys`` in the sorted ``table``, -1 where they are not."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush() -> pa.RecordBatch:
        keys = np.concatenate(held)
        keys.sort()
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return pa.RecordBatch.from_arrays([as_long(keys[first]), pa.array(np.diff(np.append(first, len(keys))))], ["key", "count"])

    held, size = [], 0
    for batch in batches:
        for words in chunks(batch.column(0), lower=True):
            held.append(words.hashes)
            size += len(words.hashes)
            if size > 3_000_000:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def sequence(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a chunk with the end after each text, and how many words of its text stand before each."""
    sizes = np.diff(words.offsets) + 1
    stops = np.cumsum(sizes) - 1
    symbols = np.full(int(sizes.sum()), END, np.uint64)
    body = np.ones(len(symbols), bool)
    body[stops] = False
    symbols[body] = words.hashes
    return symbols, np.arange(len(symbols)) - np.repeat(stops + 1 - sizes, sizes)


def gram_keys(columns: list[np.ndarray]) -> np.ndarray:
    """Keys of n-grams, one column for each place; a single symbol is its own key."""
    if len(columns) == 1:
        return columns[0]
    key = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        key = key * _BASE + column
    return mix(key + np.uint64(len(columns)))


def all_keys(symbols: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n-grams that end at each position, of no use where so many symbols are not there."""
    return gram_keys([np.roll(symbols, j) for j in range(n - 1, -1, -1)])


def distinct(columns: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of columns of numbers below ``size``, and how often each comes."""
    width = max(1, (size - 1).bit_length())
    if width * len(columns) <= 64:
        code = columns[0].astype(np.uint64)
        for c in columns[1:]:
            code = (code << np.uint64(width)) | c.astype(np.uint64)
        code.sort()
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        counts, code = np.diff(np.append(first, len(code))), code[first]
        mask = np.uint64((1 << width) - 1)
        return [(code >> np.uint64(width * j)) & mask for j in range(len(columns) - 1, -1, -1)], counts
    order = np.lexsort(columns[::-1])
    columns = [c[order].astype(np.uint64) for c in columns]
    new = np.zeros(len(order), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.diff(np.append(first, len(order)))


def _gram_blocks(n: int, bits: int, often, hot):
    """Blocks, by shard of the suffix, of a chunk's distinct n-grams and their counts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in chunks(batch.column(0), lower=True):
                symbols, back = sequence(words)
                at = np.flatnonzero(back >= n - 1)
                if often is not None:
                    known = in_bitmap(often.value, all_keys(symbols, n - 1))
                    at = at[known[at] & known[at - 1]]
                if not len(at):
                    continue
                vocabulary, numbers = np.unique(symbols, return_inverse=True)
                columns, counts = distinct([numbers[at - j] for j in range(n - 1, -1, -1)], len(vocabulary))
                hashes = [vocabulary[c] for c in columns]
                place = gram_keys(hashes[1:])
                spread_out = lookup(hot.value[0], place) >= 0
                place = np.where(spread_out, gram_keys(hashes), place)
                shard = place >> np.uint64(64 - bits)
                order = np.argsort(shard.astype(np.uint16) if bits <= 16 else shard, kind="stable")
                columns, counts = [c[order] for c in columns], counts[order]
                edges = np.searchsorted(shard[order], np.arange((1 << bits) + 1, dtype=np.uint64))
                used = np.flatnonzero(edges[1:] > edges[:-1]).tolist()
                packed = [_pack_grams([c[edges[k] : edges[k + 1]] for c in columns], counts[edges[k] : edges[k + 1]], vocabulary) for k in used]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(packed, pa.binary())], ["shard", "block"])

    return emit


def _pack_grams(columns: list[np.ndarray], counts: np.ndarray, vocabulary: np.ndarray) -> bytes:
    flat = np.concatenate(columns)
    if 8 * len(flat) > len(vocabulary):
        used = np.zeros(len(vocabulary), np.uint32)
        used[flat] = 1
        known, places = np.flatnonzero(used), (np.cumsum(used, dtype=np.uint32) - np.uint32(1))[flat]
    else:
        known, places = np.unique(flat, return_inverse=True)
    return pack_arrays([vocabulary[known], places.astype(np.uint32), counts.astype(np.uint32)])


def _unpack_grams(payload: bytes, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    known, places, counts = unpack_arrays(payload, [np.uint64, np.uint32, np.uint32])
    return [known[p] for p in places.reshape(n, -1)], counts.astype(np.int64)


_ROWS = "what int, shard int, n int, block binary"
BELOW, VALUES, ENTRIES, SUMS = range(4)  # what a block of the tables below holds
_OF_BELOW = [np.uint64, np.int64, np.float64]  # key, count, probability
_OF_ENTRIES = [np.uint64, np.uint32, np.uint64, np.int64, np.float64]  # runs of contexts, their lengths, n-grams, counts, probabilities to back off to
_OF_SUMS = [np.int64, np.float64, np.float64, np.int64, np.int64]  # hot contexts by number, and what of gain, mass, count and kinds is in one shard


def _row_batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    what, shard, n, block = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [*[pa.array(x, pa.int32()) for x in (what, shard, n)], pa.array(block, pa.binary())], ["what", "shard", "n", "block"]
    )


def _table_rows(what: int, bits: int, keys: np.ndarray, *values: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    order, parts = sharded(keys, bits)
    keys, values = keys[order], [v[order] for v in values]
    return [(what, s, at.stop - at.start, pack_arrays([keys[at], *[v[at] for v in values]])) for s, at in parts]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(x)))


def _merge(n: int, bits: int, hot):
    """Out of blocks of n-grams and the table of their suffixes: the n-grams that come ``LEAST`` times, in blocks by context.

    N-grams of hot contexts go to any shard; for these contexts there are sums of what is in each.
    """

    def add_up(parts: list) -> list:
        """Equal n-grams of the parts added up; each part goes as soon as it is joined to the others."""
        joined = []
        for i in range(3):
            joined.append(np.concatenate([p[i] for p in parts], axis=-1))
            for p in parts:
                p[i] = None
        columns, keys, counts = joined
        order = np.argsort(keys)
        keys = keys[order]
        first, _ = _runs(keys)
        return [[columns[:, order[first]], keys[first], np.add.reduceat(counts[order], first)]]

    def entries(table: list, parts: list) -> pa.RecordBatch:
        columns, keys, counts = add_up(parts)[0]
        some = counts >= LEAST
        columns, keys, counts = [c[some] for c in columns], keys[some], counts[some]
        busy, busy_p, _ = hot.value
        suffix, context = gram_keys(columns[1:]), gram_keys(columns[:-1])
        known, p = (np.concatenate(x) for x in zip(*table, strict=True)) if table else (np.zeros(0, np.uint64), np.zeros(0))
        order = np.argsort(known)
        known, p = known[order], np.append(p[order], np.nan)
        at = lookup(busy, suffix)
        above = np.where(at >= 0, np.append(busy_p, np.nan)[at], p[np.searchsorted(known, suffix)])
        rows = []
        at = lookup(busy, context)
        mine = np.flatnonzero(at >= 0)
        if len(mine):
            c, a = counts[mine], above[mine]
            own, number = np.unique(at[mine], return_inverse=True)
            sums = [np.bincount(number, c * np.log(c / a)), np.bincount(number, a), np.bincount(number, c).astype(np.int64), np.bincount(number)]
            rows.append((SUMS, 0, len(own), pack_arrays([own, *sums])))
        order, parts = sharded(np.where(at >= 0, keys, context), bits)
        context, keys, counts, above = context[order], keys[order], counts[order], above[order]
        for shard, part in parts:
            first, length = _runs(context[part])
            packed = pack_arrays([context[part][first], length.astype(np.uint32), keys[part], counts[part], above[part]])
            rows.append((ENTRIES, shard, part.stop - part.start, packed))
        return _row_batch(rows)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, table, parts, size, limit = None, [], [], 0, _GATHERED
        for shard, kind, payload in payloads(batches):
            if shard != last:
                if parts:
                    yield entries(table, parts)
                last, table, parts, size, limit = shard, [], [], 0, _GATHERED
            if kind == TABLE:
                keys, _, p = unpack_arrays(payload, _OF_BELOW)
                table.append((keys, p))
                continue
            columns, counts = _unpack_grams(payload, n)
            parts.append([np.array(columns), gram_keys(columns), counts])
            size += len(counts)
            if size > limit:
                parts = add_up(parts)
                size = len(parts[0][1])
                limit = max(_GATHERED, 2 * size)
        if parts:
            yield entries(table, parts)

    return emit


def retention(total: np.ndarray, inner: np.ndarray, mass: np.ndarray, known: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts: which are retained, by what counts are divided, and the weight of the distribution that they back off to.

    ``total``: occurrences; of the successors that count, ``inner``: sum of count * ln(count /
    probability to back off to), ``mass``: of these probabilities, ``known``: of counts, ``often``: how many.
    """
    ones = total - known
    with np.errstate(divide="ignore", invalid="ignore"):
        new = np.where(ones > 0, ones * np.log(np.maximum(ones, 1) / total / np.maximum(1 - mass, 1e-12)), 0.0)
    gain = inner - known * np.log(total) + new
    weight = total + often
    return gain > 0.5 * (often + (ones > 0)) * np.log(total), weight, (often + ones) / weight


def _level(bits: int, hot, last: bool):
    """Out of blocks of n-grams by context and the table of the contexts' counts: values, and the table for the next level."""

    def rows(table: list, parts: list) -> pa.RecordBatch:
        context, keys, counts, above = (np.concatenate(x) for x in zip(*parts, strict=True))
        known, total = (np.concatenate(x) for x in zip(*table, strict=True)) if table else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(known)
        known, total = known[order], np.append(total[order], 0)
        order = np.argsort(context, kind="stable")
        context, keys, counts, above = context[order], keys[order], counts[order], above[order]
        first, length = _runs(context)
        own = context[first]
        busy, busy_weight, busy_backoff = hot.value
        at = lookup(busy, own)
        inner = np.add.reduceat(counts * np.log(counts / above), first)
        sums = np.maximum(total[np.searchsorted(known, own)], 1), inner, np.add.reduceat(above, first), np.add.reduceat(counts, first), length
        kept, weight, backoff = retention(*sums)
        kept &= at < 0
        out = _table_rows(VALUES, bits, own[kept], np.log10(backoff[kept]), np.zeros(int(kept.sum())))
        kept = np.where(at >= 0, np.append(busy_weight, 0)[at] > 0, kept)
        weight = np.repeat(np.where(at >= 0, np.append(busy_weight, 0)[at], weight), length)
        backoff = np.repeat(np.where(at >= 0, np.append(busy_backoff, 0)[at], backoff), length)
        kept = np.repeat(kept, length)
        p = above.copy()
        p[kept] = counts[kept] / weight[kept] + backoff[kept] * above[kept]
        value = np.log10(p[kept] / above[kept] / backoff[kept])
        out += _table_rows(VALUES, bits, keys[kept], value, np.zeros(len(value)))
        if not last:
            out += _table_rows(BELOW, bits, keys, counts, p)
        return _row_batch(out)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard_now, table, parts = None, [], []
        for shard, kind, payload in payloads(batches):
            if shard != shard_now:
                if parts:
                    yield rows(table, parts)
                shard_now, table, parts = shard, [], []
            if kind == TABLE:
                keys, count, _ = unpack_arrays(payload, _OF_BELOW)
                table.append((keys, count))
            else:
                own, length, keys, counts, above = unpack_arrays(payload, _OF_ENTRIES)
                parts.append((np.repeat(own, length), keys, counts, above))
        if parts:
            yield rows(table, parts)

    return emit


def _tree_blocks(shared, depth: int, bits: int):
    """Columns row, row_text, text: blocks of each chunk's n-grams that the table may have a value for, and of numbers of tokens."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for words in chunks(batch.column(2), 3 << 20, lower=True):
                symbols, back = sequence(words)
                sizes = np.diff(words.offsets) + 1
                doc = np.repeat(np.arange(words.hi - words.lo, dtype=np.uint16), sizes)
                found: list[tuple[np.ndarray, np.ndarray]] = [(np.full(len(doc), END), doc)]
                for n in range(1, depth + 2):
                    keys = all_keys(symbols, n)
                    wanted = in_bitmap(shared.value, keys) & (back >= n - 1) & (keys != END)
                    found.append((keys[wanted], doc[wanted]))
                keys, docs = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pack_blocks((ids[words.lo : words.hi], texts[words.lo : words.hi]), *counted(keys, docs), bits)

    return emit


def _word_rows(bits: int, scale: float):
    """Out of counts of words: the table for the first level, and what the base model has for them."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, count = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            often = count >= LEAST
            rows = _table_rows(BELOW, bits, keys[often], count[often], (count[often] + 1) / scale)
            yield _row_batch(rows + _table_rows(VALUES, bits, keys, np.zeros(len(keys)), np.log10(count + 1)))

    return emit


def _busy(least: float):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                keys, count, p = unpack_arrays(block.as_py(), _OF_BELOW)
                many = count >= least
                yield pa.RecordBatch.from_arrays([as_long(keys[many]), pa.array(count[many]), pa.array(p[many])], ["key", "count", "p"])

    return emit


_SUMS = "number long, inner double, mass double, known long, often long"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in unpack_arrays(block.as_py(), _OF_SUMS)], ["number", "inner", "mass", "known", "often"])


def grow_tree(train: DataFrame, words: DataFrame, tokens: int, end: float, bits: int, depth: int, scratch: Scratch) -> list[DataFrame]:
    """Blocks of what each n-gram adds to the base's log10 probabilities. ``words``: the rows of ``_word_rows``."""
    spark = train.sparkSession
    rows, often, values = words, None, []
    for length in range(1, depth + 1):
        below = rows.where(F.col("what") == BELOW).select("shard", "n", "block")
        busy = below.select("block").mapInArrow(_busy(tokens / HOT), "key long, count long, p double").toPandas()  # HOT rows at most
        keys, count, p = busy["key"].to_numpy(np.int64).view(np.uint64), busy["count"].to_numpy(np.int64), busy["p"].to_numpy(np.float64)
        if length == 1:
            keys, count, p = np.append(keys, END), np.append(count, 0), np.append(p, end)
        order = np.argsort(keys)
        keys, count, p = keys[order], count[order], p[order]
        hot = spark.sparkContext.broadcast((keys, p, count))
        blocks = train.mapInArrow(_gram_blocks(length + 1, bits, often, hot), "shard int, block binary")
        merged = scratch.put_clean(meet(below, blocks, bits).mapInArrow(_merge(length + 1, bits, hot), _ROWS), f"entries{length}")

        parts = merged.where(F.col("what") == SUMS).select("block").mapInArrow(_sums, _SUMS).groupBy("number")
        found = parts.agg(*[F.sum(c).alias(c) for c in ("inner", "mass", "known", "often")]).toPandas()  # HOT rows at most
        sums = [np.zeros(len(keys)) for _ in range(4)]
        for total, column in zip(sums, ("inner", "mass", "known", "often"), strict=True):
            total[found["number"].to_numpy(np.int64)] = found[column].to_numpy(np.float64)
        some = (sums[-1] > 0) & (count > 0)
        kept, weight, backoff = retention(np.maximum(count, 1), *sums)
        kept &= some
        settled = spark.sparkContext.broadcast((keys, np.where(kept, weight, 0), backoff))
        own = _table_rows(VALUES, bits, keys[kept], np.log10(backoff[kept]), np.zeros(int(kept.sum())))

        entries = merged.where(F.col("what") == ENTRIES).select("shard", "block")
        rows = scratch.put_clean(meet(below, entries, bits).mapInArrow(_level(bits, settled, length == depth), _ROWS), f"level{length}", "what")
        scratch.drop(f"entries{length}")
        scratch.drop("words" if length == 1 else f"level{length - 1}", f"what={BELOW}")
        values.append(rows)
        if own:
            values.append(spark.createDataFrame([(w, s, n, bytearray(b)) for w, s, n, b in own], _ROWS))
        if length < depth:
            often = spark.sparkContext.broadcast(bitmap(rows.where(F.col("what") == BELOW), bits, _MOST_BITS))
    return [x.where(F.col("what") == VALUES).select("shard", "n", "block") for x in values]


def score_texts(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_out: Column | None = None,
    depth: int = 2,
) -> DataFrame:
    """Per document ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``held_out`` tells which rows are not learned from (default: crc32 of the id as text,
    modulo 7, is 2). Contexts have up to ``depth`` words, from 1 on.
    """
    if depth < 1:
        raise ValueError("depth must be 1 or more")
    spark = docs.sparkSession
    out = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(7)) == 2 if held_out is None else held_out
    texts = named(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), out.alias("held_out")))
    train = texts.where("not held_out").select("text")
    with Scratch(spark) as scratch:
        counts = train.mapInArrow(_word_counts, "key long, count long").groupBy("key").agg(F.sum("count").alias("count"))
        counts = scratch.put_clean(counts, "counts")
        ends = train.count()
        words, tokens = counts.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
        total = tokens + ends
        scale = total + words + (ends > 0) + 1
        bits = min(20, shard_bits(total >> 1))
        known = scratch.put_clean(counts.mapInArrow(_word_rows(bits, float(scale)), _ROWS), "words", "what")
        scratch.drop("counts")
        table = known.where(F.col("what") == VALUES).select("shard", "n", "block")
        for level in grow_tree(train, known, total, (ends + 1) / scale, bits, depth, scratch):
            table = table.unionByName(level)
        shared = spark.sparkContext.broadcast(bitmap(table, bits, _MOST_BITS))
        fewer = min(bits, shard_bits((table.agg(F.sum("n")).first()[0] or 0) >> 1))
        table = table.withColumn("shard", F.shiftright("shard", bits - fewer))
        columns, turns = ["value", "base"], []
        for turn in range(TURNS):
            some = texts.where(F.pmod("row_text", F.lit(TURNS)) == turn).select("row", "row_text", "text")
            blocks = some.mapInArrow(_tree_blocks(shared, depth, fewer), "shard int, block binary")
            sums = join_blocks(blocks, table, columns, fewer, 0, int(END)).groupBy("row", "row_text")
            turns.append(scratch.put_clean(sums.agg(*[F.sum(c).alias(c) for c in (*columns, "base_found", "of_special", "alike")]), f"sums{turn}"))
        sums = reduce(DataFrame.unionByName, turns)
        each = [(F.col(c) / F.col("alike")).alias(c) for c in ("value", "base", "base_found", "of_special")]
        sums = sums.select("row", "row_text", *each)
        base_score = F.col("base") + float(np.log10(ends + 1)) + F.col("of_special") * F.lit(float(np.log10(1 / scale)))
        result = texts.drop("text").join(sums, ["row", "row_text"]).select(
            "doc_id",
            F.coalesce("held_out", F.lit(False)).alias("held_out"),
            F.col("of_special").cast("long").alias("n_tokens"),
            (F.col("base_found") + int(ends > 0)).cast("long").alias("n_known"),
            F.lit(int(total)).cast("long").alias("train_tokens"),
            base_score.alias("base_score"),
            (base_score + F.col("value")).alias("score"),
        )
        return cut(result)
