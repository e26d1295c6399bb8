"""Best-fit packing of token sequences, by hierarchical residual packing.

Every partition tokenizes its documents and packs their pieces best-fit (largest first). Nearly full
bins are emitted at once. Underfull bins become items of the next round: the bins of FAN_IN groups meet
in one task and are packed best-fit again, as a tree, until one group is left. A group of less than
FEWEST items would waste room: they go on as they are. So that no task grows with the input, a group
carries at most CARRY_BINS bins of at most CARRY_PIECES pieces to the next round, the emptiest. The others, and if there are any the tree's last underfull bins with them, are
packed by counts: best-fit depends on sizes alone, so it is planned from the number of bins of each of
the `capacity` sizes, and each bin finds its place in that plan by its rank among those of its size.

A document's tokens are its ids and the end id. Only longer documents are cut, into pieces of
`capacity` tokens, the first of which may be shorter.

Defined cases. A null or empty text is the end id alone. Repeated rows are packed each. A null doc_id
is kept. Very long texts are tokenized whole. Further columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, map_arrow, small_batches

CAPACITY, END_ID = 2048, 0
#: A bin with at most this much room left is nearly full.
NEARLY = 8
FAN_IN, FEWEST, CARRY_BINS, CARRY_PIECES = 8, 1024, 4096, 1 << 16
#: Pieces that a task packs at a time.
FLUSH_PIECES = 1 << 19
#: What becomes of a bin: it is emitted, goes to the next round, or is packed by counts.
DONE, NEXT, REST = 0, 1, 2
#: Words that one worker remembers the ids of: the first that come again, so the frequent ones.
MEMORY = 300_000


def _class(first: str, below: int = 0x250) -> str:
    return "".join(re.escape(chr(c)) for c in range(below) if unicodedata.category(chr(c))[0] == first)


_L, _N, _S = _class("L"), _class("N"), "\\t-\\r \\x85\\xa0"
#: The pre-tokenizer's pattern for texts of the characters below U+0250 and a few more; others are left to the library.
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
OTHER = "[^\\x00-\\u024f\\u2010-\\u2027\\u20ac]"


class Encoder:
    """Ids by the tokenizers library, which encodes each different word once; texts it can't split surely are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: What `WORDS` can't split: other characters, and the strings of added tokens, which are tokens in a text too.
        self.other = re.compile("|".join([OTHER, *map(re.escape, added)]))
        self.newline = self._ids("\n")
        self.split = len(self.newline) == 1 and self._ids("a\n b\nc") == self._ids("a") + self.newline + self._ids(" b") + self.newline + self._ids("c")
        self.seen = np.zeros(1 << 22, bool)
        self.known: dict[str, int] = {}
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _fresh(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and joined ids of words without inner white space, which are encoded together, a line each."""
        lines = ["\n".join(words[a : a + 64]) for a in range(0, len(words), 64)]
        ids = np.concatenate([np.array([*e.ids, self.newline[0]], np.uint32) for e in self.library.encode_batch_fast(lines, add_special_tokens=False)])
        cut = np.flatnonzero(ids == self.newline[0])
        if len(cut) != len(words):
            raise RuntimeError("the vocabulary joins line ends with words")
        return np.diff(np.append(-1, cut)) - 1, ids[ids != self.newline[0]]

    @staticmethod
    def _odd(word: str) -> bool:
        return "\n" in word or word.isspace() or word[1:].isspace()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        odd = {i for i, t in enumerate(texts) if not self.split or self.other.search(t)}
        words = [[] if i in odd else WORDS.findall(t) for i, t in enumerate(texts)]
        flat = [w for part in words for w in part]
        at = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        start, ids = self.start, self.ids
        missed = np.flatnonzero(at < 0)
        if len(missed):
            new: dict[str, int] = {}
            number = np.fromiter((new.setdefault(flat[i], len(new)) for i in missed.tolist()), np.int64, len(missed))
            names = list(new)
            plain = [i for i, w in enumerate(names) if not self._odd(w)]
            rest = [i for i, w in enumerate(names) if self._odd(w)]
            order = np.empty(len(names), np.int64)
            order[plain + rest] = np.arange(len(names))
            at[missed] = len(start) - 1 + order[number]
            parts = [self._fresh([names[i] for i in plain])] if plain else []
            parts += [(np.array([len(x)]), np.array(x, np.uint32)) for x in (self._ids(names[i]) for i in rest)]
            sizes = np.concatenate([p[0] for p in parts])
            start, ids = np.concatenate([start, start[-1] + np.cumsum(sizes)]), np.concatenate([ids, *(p[1] for p in parts)])
        size = start[at + 1] - start[at]
        ends = np.cumsum(size)
        out_ids = ids[np.arange(int(size.sum())) + np.repeat(start[at] - (ends - size), size)]
        upto = np.concatenate([[0], ends])[np.cumsum([len(p) for p in words])]
        out = np.split(out_ids, upto[:-1])
        whole = sorted(odd)
        for i, e in zip(whole, self.library.encode_batch([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        if len(missed):
            self._remember([names[i] for i in plain + rest], start, ids)
        return out

    def _remember(self, names: list[str], start: np.ndarray, ids: np.ndarray) -> None:
        """Keep those of the new words that an earlier batch had too: most words never come again."""
        place = np.fromiter(map(hash, names), np.int64, len(names)) & (len(self.seen) - 1)
        again = np.flatnonzero(self.seen[place])
        self.seen[place] = True
        again = again[: max(0, MEMORY - len(self.known))]
        if not len(again):
            return
        n = len(self.start) - 1
        sizes = start[n + again + 1] - start[n + again]
        ends = np.cumsum(sizes)
        own = ids[np.arange(int(sizes.sum())) + np.repeat(start[n + again] - (ends - sizes), sizes)]
        self.known.update((names[i], n + j) for j, i in enumerate(again.tolist()))
        self.start, self.ids = np.concatenate([self.start, self.start[-1] + ends]), np.concatenate([self.ids, own])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item, and the bins' fills: largest items first, each into the fullest bin with room for it."""
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fills: list[int] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room left
    some = 0  # bit r: is there a bin with room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        fit = some >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some &= ~(1 << r)
        else:
            r, b = capacity, len(fills)
            fills.append(0)
        where[i], offset[i] = b, fills[b]
        fills[b] += n
        left = r - n
        if left:
            room[left].append(b)
            some |= 1 << left
    return where, offset, np.array(fills, np.int64)


SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long, part long, state int, rank long"
PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]


class Rules(NamedTuple):
    """Room left in a bin that is nearly full; items of a group that is packed; bins that a group carries on."""

    nearly: int = NEARLY
    fewest: int = FEWEST
    carry: int = CARRY_BINS


def _group(sizes: np.ndarray, pieces: np.ndarray, capacity: int, rules: Rules, last: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pack a group's items, each of which holds some pieces: their bins and offsets, and the fills and states of bins."""
    if len(sizes) < rules.fewest and not last:
        where, offset, fills = np.arange(len(sizes)), np.zeros(len(sizes), np.int64), sizes
    else:
        where, offset, fills = best_fit(sizes, capacity)
    held = np.bincount(where, pieces)
    states = np.full(len(fills), DONE)
    under = np.flatnonzero(capacity - fills > rules.nearly)
    order = under[np.argsort(fills[under], kind="stable")]
    carried = (np.arange(len(order)) < rules.carry) & (np.cumsum(held[order]) <= CARRY_PIECES)
    states[order] = np.where(carried | last, NEXT, REST)
    return where, offset, fills, states


class _Ranks:
    """Numbers a group's bins that are packed by counts, by fill."""

    def __init__(self, capacity: int):
        self.next = np.zeros(capacity + 1, np.int64)

    def __call__(self, fills: np.ndarray, states: np.ndarray, every: bool = False) -> np.ndarray:
        out = np.zeros(len(fills), np.int64)
        at = np.flatnonzero(states != DONE) if every else np.flatnonzero(states == REST)
        order = at[np.argsort(fills[at], kind="stable")]
        sizes, first, n = np.unique(fills[order], return_index=True, return_counts=True)
        out[order] = np.arange(len(order)) - np.repeat(first, n) + np.repeat(self.next[sizes], n)
        self.next[sizes] += n
        return out


def _pieces(path: str, capacity: int, rules: Rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        tokens, part, ranks = encoder(path), TaskContext.get().partitionId(), _Ranks(capacity)
        rows: list[tuple] = []
        n_bins = 0

        def packed() -> Iterator[dict]:
            nonlocal n_bins
            doc_id, piece, start, length, crc = (list(x) for x in zip(*rows, strict=True))
            where, offset, fills, states = _group(np.array(length), np.ones(len(length)), capacity, rules)
            yield {"doc_id": doc_id, "piece": piece, "start": start, "length": length, "ids_crc32": crc, "bin": where + n_bins + (part << 32), "offset": offset, "fill": fills[where], "part": np.full(len(where), part), "state": states[where], "rank": ranks(fills, states)[where]}
            n_bins += len(fills)
            rows.clear()

        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1).fill_null("").to_pylist()
            for doc_id, found in zip(ids, tokens.encode(texts), strict=True):
                all_ids = np.append(found, np.uint32(END_ID)).astype("<u4")
                pieces = -(-len(all_ids) // capacity)
                start = 0
                for k in range(pieces):
                    end = len(all_ids) - (pieces - 1 - k) * capacity
                    rows.append((doc_id, k, start, end - start, zlib.crc32(all_ids[start:end].tobytes())))
                    start = end
            if len(rows) >= FLUSH_PIECES:
                yield from packed()
        if rows:
            yield from packed()

    return run


def _merge(capacity: int, rules: Rules, last: bool):
    """Pack the bins of each group, whole, as items. A task may get several groups, and rows come in any order; a group's rows fit in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        every = pa.Table.from_batches(held)
        groups = every["part"].to_numpy() // FAN_IN
        order = np.argsort(groups, kind="stable")
        numbers, first = np.unique(groups[order], return_index=True)
        for group, at in zip(numbers.tolist(), np.split(order, first[1:]), strict=True):
            table = every.take(pa.array(at))
            _, one, own, pieces = np.unique(table["bin"].to_numpy(), return_index=True, return_inverse=True, return_counts=True)
            where, offset, fills, states = _group(table["fill"].to_numpy()[one], pieces, capacity, rules, last)
            ranks = _Ranks(capacity)(fills, states, last)
            to = where[own]
            yield {n: table[n] for n in PIECE} | {"bin": to + (group << 32), "offset": table["offset"].to_numpy() + offset[own], "fill": fills[to], "part": np.full(len(own), group), "state": states[to], "rank": ranks[to]}

    return run


def plan_by_counts(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit from the number of items of each size: rows (size, first rank, items, first bin, items a bin, offset).

    The items of a row, by rank, fill its bins one after another, from that offset on. Bins of equal room are
    handled together, so the plan's size depends on the number of sizes alone. The fills are those of best_fit.
    """
    plan: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # bins with that much room: (first, number)
    bins = 0
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0

        def place(first: int, n: int, r: int, size: int = size) -> None:
            """Fill n bins of room r as long as there are items."""
            nonlocal left, rank
            each = r // size
            whole = min(n, left // each)
            for start, m, k in ((first, whole, each), (first + whole, int(n > whole and left > whole * each), left - whole * each)):
                if m:
                    plan.append((size, rank, m * k, start, k, capacity - r))
                    if r - k * size:
                        room.setdefault(r - k * size, []).append((start, m))
                    rank, left, first, n = rank + m * k, left - m * k, start + m, n - m
            if n:
                room.setdefault(r, []).append((first, n))

        for r in sorted(x for x in room if x >= size):
            for first, n in room.pop(r):
                if left:
                    place(first, n, r)
                else:
                    room.setdefault(r, []).append((first, n))
        if left:
            n = -(-left // (capacity // size))
            place(bins, n, capacity)
            bins += n
    return np.array(plan, np.int64).reshape(-1, 6)


def _placed(plan: np.ndarray, first_bin: int):
    """Bins' rows (the last column is the rank among all of their fill) at their places in the plan."""
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    width = int((plan[:, 1] + plan[:, 2]).max()) + 1
    keys = plan[:, 0] * width + plan[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            fill, rank = b.column("fill").to_numpy(), b.column("rank").to_numpy()
            p = plan[np.searchsorted(keys, fill * width + rank, "right") - 1]
            j = rank - p[:, 1]
            yield {n: b.column(n) for n in PIECE} | {"bin": first_bin - (p[:, 3] + j // p[:, 4]), "offset": b.column("offset").to_numpy() + p[:, 5] + j % p[:, 4] * fill}

    return run


def _by_counts(rest: DataFrame, scratch: Scratch, capacity: int) -> DataFrame:
    """Pack bins as items by the counts of their fills. Columns source and rank number the bins of a fill; a bin's first piece stands for it."""
    heads = rest.filter("offset = 0").groupBy("source", "fill").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("fill").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)  # a row for each source, not for each bin
    base = scratch.table(heads.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "ranks")
    counts = {r.fill: r.n for r in base.groupBy("fill").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    ranked = rest.join(base.select("source", "fill", "before"), ["source", "fill"]).select(*PIECE, "offset", "fill", (F.col("rank") + F.col("before")).alias("rank"))
    return map_arrow(ranked, _placed(plan_by_counts(counts, capacity), -1), "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long")


def pack(docs: DataFrame, path: str, *, capacity: int = CAPACITY, rules: Rules = Rules()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset. path: a tokenizers file."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rounds = [scratch.table(map_arrow(rows, _pieces(path, capacity, rules), SCHEMA), "round_0")]
    top = rounds[0].filter(F.col("state") == NEXT).agg(F.max("part").alias("top")).first().top
    while top is not None:
        groups = top // FAN_IN + 1
        dealt = rounds[-1].filter(F.col("state") == NEXT).repartition(int(groups), F.floor(F.col("part") / FAN_IN))
        rounds.append(scratch.table(map_arrow(dealt, _merge(capacity, rules, groups == 1), SCHEMA), f"round_{len(rounds)}"))
        top = None if groups == 1 else rounds[-1].filter(F.col("state") == NEXT).agg(F.max("part").alias("top")).first().top
    ends = [r.withColumn("source", F.col("part") + F.lit(n << 40)).withColumn("bin", F.col("bin") + F.lit(n << 26)) for n, r in enumerate(rounds)]
    rest = reduce(DataFrame.union, [r.filter(F.col("state") == REST) for r in ends])
    left = rest.union(ends[-1].filter(F.col("state") == NEXT))
    if not rest.isEmpty():  # else the last group has packed all that was left
        left = _by_counts(left, scratch, capacity)
    final = [*PIECE, F.col("bin").alias("sequence_id"), "offset"]
    return reduce(DataFrame.union, [r.filter(F.col("state") == DONE).select(*final) for r in ends]).union(left.select(*final))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
