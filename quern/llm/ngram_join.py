"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are its distinct k-word shingles. Tokens are put into classes by how many
documents hold them: rare ones are indexed singly, frequent ones in combinations of two, very
frequent ones of three. In the order (class, hash) each document indexes a prefix that is extended
until any document similar enough must share a signature with it: with m tokens outside the
overlap at most, the prefix must be able to lose m tokens and still hold a rare token, or enough
tokens of one combination group. Candidates are then verified on whole sets.

Defined cases. Null, empty or wordless texts have an empty set and no links. A text of fewer than
k words is one token. Equal sets form one class and are compared once. Repeated rows are linked
with each other; rows whose doc_id is null get n_shingles and a null component_id. Any further
columns of the input are ignored. An empty table gives an empty result.

Counts are over all documents. The classes reach the tasks as two bit maps, whose size follows the number
of frequent tokens up to MOST_BITS; a false hit only makes a rare token frequent, which costs time and no
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import components, forest
from .shared import Scratch, longs, map_arrow, partitions, small_batches
from .textkit import mix64, shingle_sets, splitmix

SHINGLE_WORDS = 5
PERCENT = 75
#: Bits of a map that is broadcast, for each value in it and within these bounds (128 KB to 32 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28
#: Large buckets up to which a row of 48 bytes for each is broadcast to their members; beyond, members are shuffled.
BROADCAST_BUCKETS = 1 << 19
#: Documents with a token in their plain prefix above which it is frequent, and very frequent.
FREQUENT = (16, 1024)
#: Index entries up to which a signature's documents are paired one by one.
SMALL = 64
#: Tokens by which prefixes of rare tokens are longer than needed; pairs must then share more of them.
SLACK = 4
FLUSH_DOCS, FLUSH_CODES, FLUSH_PAIRS = 8192, 1 << 20, 1 << 19
LEAST_LEVEL = 4
BLOCK, ASKING = 1024, 1024
#: Documents of large buckets that each other document of theirs is compared with first.
LEADERS = 4
#: Partners of a class that are compared with it in one group of rows.
PARTNERS = 128

_GROUP = splitmix(64, 37)
#: An index entry: 48 bits of the signature (the highest tells combinations from single tokens; the shard
#: tells more of them), the class, and its size with its spare rare tokens.
ENTRY = np.dtype([("sig", "<u4"), ("high", "<u2"), ("cls", "<i8"), ("told", "<u4")])


def map_bits(values: int) -> int:
    """Size of a bit map for so many values."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * values).bit_length()))


def overlap(n: int | np.ndarray, percent: int):
    """Tokens that a set of n shares at least with any set similar enough."""
    return -(-percent * n // 100)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, set) of each row of (doc_id, text)."""
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), k), strict=True)


def _planes(x: np.ndarray) -> bytes:
    """Sorted 32-bit values as steps, byte by byte: most of the high bytes are zero and compress."""
    return np.diff(x, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _pack_counts(code: np.ndarray, count: np.ndarray) -> bytes:
    """Of sorted codes: those counted once, then the others and their counts."""
    more = count > 1
    return np.uint32((~more).sum()).tobytes() + _planes(code[~more]) + _planes(code[more]) + np.minimum(count[more], 2**32 - 1).astype("<u4").tobytes()


def _unpack_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    m = (len(data) - 4 - 4 * n) // 8
    steps = lambda at, size: np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * size, at).reshape(4, size).T).view("<u4").ravel(), dtype=np.uint32)
    return np.concatenate([steps(4, n), steps(4 + 4 * n, m)]), np.concatenate([np.ones(n), np.frombuffer(data, "<u4", m, 4 + 4 * n + 4 * m)])


def _profile(k: int, percent: int, shards: int):
    """Rows of each document (shard null), and token counts of plain prefixes dealt over shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows: tuple[list, list, list] = ([], [], [])
        codes: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[dict]:
            nonlocal rows, codes, size
            n = len(rows[0])
            if n:
                yield {"doc_id": rows[0], "n": rows[1], "cls": rows[2], "shard": [None] * n, "counts": [None] * n}
            if codes:
                code, count = np.unique(np.concatenate(codes), return_counts=True)
                shard = (code % np.uint32(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                cut = np.searchsorted(shard[order], np.arange(shards + 1))
                full = np.flatnonzero(np.diff(cut))
                yield {"doc_id": [None] * len(full), "n": [None] * len(full), "cls": [None] * len(full), "shard": full.tolist(), "counts": [_pack_counts(code[order[cut[s] : cut[s + 1]]], count[order[cut[s] : cut[s + 1]]]) for s in full]}
            rows, codes, size = ([], [], []), [], 0

        for doc_id, s in _sets(batches, k):
            rows[0].append(doc_id)
            rows[1].append(len(s))
            rows[2].append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
            if len(s):
                codes.append(s[: len(s) - overlap(len(s), percent) + 1].astype(np.uint32))
                size += len(codes[-1])
            if size >= FLUSH_CODES or len(rows[0]) >= 8 * FLUSH_DOCS:
                yield from flush()
        yield from flush()

    return run


def _frequent(limits: tuple[int, int]):
    """Codes above the limits, out of shards that each lie in one partition whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held = [_unpack_counts(x.as_py()) for batch in batches for x in batch.column(1)]
        if held:
            both, times = (np.concatenate(x) for x in zip(*held, strict=True))
            code, at = np.unique(both, return_inverse=True)
            count = np.bincount(at, weights=times)
            often = count > limits[0]
            yield {"code": code[often].astype(np.int64), "very": count[often] > limits[1]}

    return run


def _classes(counts: DataFrame, bits: int | None, limits: tuple[int, int], scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Bit maps of frequent and very frequent codes, packed; bits: their size, else from the number of codes."""
    codes, n, _ = scratch.counted(map_arrow(counts, _frequent(limits), "code long, very boolean"))
    bits = bits or map_bits(n)
    words = codes.withColumn("bit", F.col("code") % bits)
    one = F.expr("shiftleft(1L, cast(bit % 64 as int))")
    words = words.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(one).alias("often"), F.coalesce(F.bit_or(F.when(F.col("very"), one)), F.lit(0)).alias("very"))
    maps = np.zeros((2, bits // 64), np.int64)
    for row in words.collect():  # at most bits / 64 rows
        maps[0, row.word], maps[1, row.word] = row.often, row.very
    return maps[0].view(np.uint8), maps[1].view(np.uint8)


def holds(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which bits of a packed map are set."""
    return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def signatures(s: np.ndarray, often: np.ndarray, very: np.ndarray, percent: int = PERCENT, slack: int = SLACK) -> tuple[np.ndarray, int, np.ndarray]:
    """(tokens indexed singly, how many rare ones its prefix has, hashes of combinations) of a sorted set."""
    n = len(s)
    need = n - overlap(n, percent) + 1
    at = s.astype(np.uint32).astype(np.int64) % (8 * len(often))
    common = holds(often, at)
    larger = n * 100 // percent
    # two sets meet at the level of the larger one; below LEAST_LEVEL sets are too small for combinations
    levels = sorted({n.bit_length() - 1, larger.bit_length() - 1})
    plain = s[: need + slack]
    if levels[-1] < LEAST_LEVEL:
        return plain, len(plain), np.zeros(0, np.uint64)
    mixed = levels[0] < LEAST_LEVEL
    levels = [x for x in levels if x >= LEAST_LEVEL]
    rare = s[~common]
    singles = rare[: need + slack]
    if len(singles) >= need:
        return (np.union1d(singles, plain), 0, np.zeros(0, np.uint64)) if mixed else (singles, len(singles), np.zeros(0, np.uint64))
    s, three = s[common], holds(very, at[common])
    s = np.concatenate([s[~three], s[three]])
    two = int((~three).sum())
    found: set[int] = set()
    for level in levels:
        most = (1 << level) // 4, (1 << level) // 8
        group = np.empty(len(s), np.int64)
        with np.errstate(over="ignore"):
            spread = mix64(s * _GROUP[level]) >> np.uint64(33)
        group[:two] = (spread[:two] % np.uint64(most[0])).astype(np.int64)
        group[two:] = (spread[two:] % np.uint64(most[1])).astype(np.int64) + most[0]
        members: dict[int, list[int]] = {}
        lost = len(rare)
        for g, token in zip(group.tolist(), s.tolist(), strict=True):
            if lost >= need:
                break
            k = 2 if g < most[0] else 3
            own = members.setdefault(g, [])
            own.append(token)
            lost += len(own) >= k
        for g, own in members.items():
            for c in combinations(own, 2 if g < most[0] else 3):
                found.add(hash((level, g, *c)) & 0xFFFFFFFFFFFFFFFF)
    return np.union1d(rare, plain) if mixed else rare, 0 if mixed else len(rare), mix64(np.fromiter(found, np.uint64, len(found)))


def _index(k: int, percent: int, shards: int, maps, slack: int):
    """Index entries of each class of equal sets, dealt over shards: combinations have the sign that singles lack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        often, very = maps.value
        seen: set[int] = set()
        meta: list[tuple[int, int]] = []
        entries: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[dict]:
            nonlocal size
            if entries:
                sig = np.concatenate(entries)
                shard = (mix64(sig) % np.uint64(shards)).astype(np.int64)
                rows = np.zeros(len(sig), ENTRY)
                rows["sig"], rows["high"] = (sig & np.uint64(0xFFFFFFFF)), ((sig >> np.uint64(48)) & np.uint64(0xFFFF))
                cls, told = (np.repeat(np.array(x, np.int64), [len(e) for e in entries]) for x in zip(*meta, strict=True))
                rows["cls"], rows["told"] = cls, told
                order = np.argsort(shard, kind="stable")
                rows, cut = rows[order], np.searchsorted(shard[order], np.arange(shards + 1))
                full = np.flatnonzero(np.diff(cut)).tolist()
                for s in full:
                    yield {"shard": [s], "entries": [rows[cut[s] : cut[s + 1]].tobytes()]}
            seen.clear(), meta.clear(), entries.clear()
            size = 0

        for doc_id, s in _sets(batches, k):
            if not len(s) or doc_id is None:
                continue
            cls = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)
            if cls in seen:
                continue
            seen.add(cls)
            single, r, combined = signatures(s, often, very, percent, slack)
            entries.append(np.concatenate([single & np.uint64(2**63 - 1), combined | np.uint64(2**63)]))
            spare = max(0, r - (len(s) - overlap(len(s), percent) + 1) + 1)  # 0: too few rare tokens to prune by
            meta.append((cls, len(s) << 3 | min(spare, 7)))
            size += len(entries[-1])
            if len(meta) >= FLUSH_DOCS or size >= FLUSH_CODES:
                yield from flush()
        yield from flush()

    return run


def _meet(percent: int, small: int):
    """Of the shards in a partition: pairs that share signatures of few documents (bucket null), and the members of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held_ = [np.frombuffer(x.as_py(), ENTRY) for batch in batches for x in batch.column(0)]
        if not held_:
            return
        rows = np.concatenate(held_)
        del held_
        sig = rows["sig"].astype(np.uint64) | rows["high"].astype(np.uint64) << np.uint64(48)
        # number the classes; rows of one class from several tasks become one
        cls, first, own = np.unique(rows["cls"], return_index=True, return_inverse=True)
        n, r = (rows["told"][first] >> 3).astype(np.int64), (rows["told"][first] & 7).astype(np.int64)
        del rows
        order = np.lexsort((own, sig))
        sig, own = sig[order], own[order]
        keep = np.append(True, (sig[1:] != sig[:-1]) | (own[1:] != own[:-1]))
        sig, own = sig[keep], own[keep]
        head = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        count = np.diff(np.append(head, len(sig)))
        held: list[np.ndarray] = []
        size = 0

        def pairs() -> Iterator[dict]:
            if held:  # a pair and whether a combination or a token was shared, in one number
                key, times = np.unique(np.concatenate(held), return_counts=True)
                u, v, combined = key >> 32, (key >> 1) & 0x7FFFFFFF, key & 1
                yield {"a": cls[u], "b": cls[v], "na": n[u], "nb": n[v], "ra": r[u], "rb": r[v], "rare": np.where(combined == 0, times, 0), "bucket": pa.nulls(len(u), pa.int64())}

        for c in np.unique(count[(count > 1) & (count <= small)]).tolist():
            heads = head[count == c]
            i, j = np.triu_indices(c, 1)
            step = max(1, FLUSH_PAIRS // len(i))
            for k in range(0, len(heads), step):
                at = heads[k : k + step, None]
                u, v = own[at + i].ravel(), own[at + j].ravel()
                combined = np.broadcast_to(sig[at] >> np.uint64(63), (len(at), len(i))).ravel().astype(np.int64)
                ok = np.minimum(n[u], n[v]) * 100 >= percent * np.maximum(n[u], n[v])
                held.append(u[ok] << 32 | v[ok] << 1 | combined[ok])
                size += int(ok.sum())
                if size >= FLUSH_PAIRS:
                    yield from pairs()
                    held, size = [], 0
        yield from pairs()
        for h in np.flatnonzero(count > small).tolist():
            m = own[head[h] : head[h] + count[h]]
            none = pa.nulls(len(m), pa.int64())
            yield {"a": cls[m], "b": none, "na": n[m], "nb": none, "ra": none, "rb": none, "rare": none, "bucket": np.full(len(m), longs(sig[head[h] : head[h] + 1])[0])}

    return run


def _needed_sets(k: int, maps):
    """(cls, set) of documents whose doc_id and class may be among the needed ones; each class once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bloom, classes = maps.value
        seen: set[int] = set()
        for batch in batches:
            ids = np.array([0 if x is None else x for x in batch.column(0).to_pylist()], np.int64)
            hit = holds(bloom, (mix64(ids.view(np.uint64)) % np.uint64(8 * len(bloom))).astype(np.int64)) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            if not hit.any():
                continue
            at = pa.array(np.flatnonzero(hit))
            sets = list(shingle_sets(batch.column(1).take(at), k))
            cls = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets]
            some = holds(classes, (mix64(np.array(cls, np.int64).view(np.uint64)) % np.uint64(8 * len(classes))).astype(np.int64))
            out = {c: s for c, s, ok in zip(cls, sets, some.tolist(), strict=True) if ok and c not in seen}
            seen.update(out)
            if out:
                yield {"cls": list(out), "tokens": [s.view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for s in out.values()]}

    return run


def unpack(tokens: bytes) -> np.ndarray:
    """48 bits of each token, as one array."""
    packed = np.frombuffer(tokens, np.uint8).reshape(-1, 6)
    out = np.zeros((len(packed), 8), np.uint8)
    out[:, :6] = packed
    return out.view(np.uint64).ravel()


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _verify(percent: int):
    """Pairs that hold. Rows come sorted by (a, salt, b): the set of a first (b null), then those of its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, mine = None, None
        for batch in batches:
            a, b = [], []
            for x, y, tokens in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if y is None:
                    now, mine = x, unpack(tokens.as_py())
                elif x == now and similar(mine, unpack(tokens.as_py()), percent):
                    a.append(x)
                    b.append(y)
            if a:
                yield {"a": a, "b": b}

    return run


def _block(percent: int):
    """Links between components in a block of one large bucket (side 1) and the members that ask (side 0), as a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        side, comp, cls = (table.column(c).to_numpy() for c in ("side", "comp", "cls"))
        sets = [unpack(x.as_py()) for x in table.column("tokens")]
        size = np.array([len(x) for x in sets])
        tokens, local = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), size)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        shared = np.zeros((len(left), len(right)), np.float32)
        often = np.bincount(local, minlength=len(tokens)) > 1
        number = np.cumsum(often) - 1
        row, local = row[often[local]], number[local[often[local]]]
        for first in range(0, int(often.sum()), 2048):  # a slice of the vocabulary at a time
            part = (local >= first) & (local < first + 2048)
            dense = np.zeros((len(sets), min(2048, int(often.sum()) - first)), np.float32)
            dense[row[part], local[part] - first] = 1
            shared += dense[left] @ dense[right].T
        hold = (100 * shared >= percent * (size[left][:, None] + size[right][None] - shared)) & (comp[left][:, None] != comp[right][None])
        i, j = np.nonzero(hold)
        v, m = forest(cls[left[i]], cls[right[j]]) if len(i) else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": pa.array(v, pa.int64()), "b": pa.array(m, pa.int64())})

    return run


def _sets_of(docs: DataFrame, classes: DataFrame, needed: DataFrame, k: int, scratch: Scratch, name: str) -> DataFrame:
    """(cls, tokens) of the needed classes, and of few others; some classes may come more than once.

    Two Bloom filters, of the doc_ids and of the classes, spare the other documents' hashing
    and keep their sets out, so that no texts or sets are shuffled to choose them.
    """
    ids, n, _ = scratch.counted(needed.distinct().join(classes, "cls").select("cls", F.col("first").alias("doc_id")))
    spark, bits = docs.sparkSession, map_bits(n)
    words = map_arrow(ids.select("doc_id", "cls"), _bloom_bits(bits), "filter int, word long, mask long").groupBy("filter", "word").agg(F.bit_or("mask").alias("mask"))
    filters = np.zeros((2, bits // 64), np.int64)
    for row in words.collect():  # at most 2 * bits / 64 rows
        filters[row["filter"], row.word] = row.mask
    filters = tuple(x.view(np.uint8) for x in filters)
    return scratch.table(map_arrow(docs, _needed_sets(k, spark.sparkContext.broadcast(filters)), "cls long, tokens binary"), name)


def _bloom_bits(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for f in range(2):
                bit = (mix64(batch.column(f).to_numpy().view(np.uint64)) % np.uint64(bits)).astype(np.int64)
                yield {"filter": np.full(len(bit), f), "word": bit // 64, "mask": longs(np.uint64(1) << (bit % 64).astype(np.uint64))}

    return run


def _spread(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each bucket, as a table for joins with the buckets' members: these stay where they are, unless the buckets are too many to broadcast."""
    table, n, _ = scratch.counted(rows)
    return F.broadcast(table) if n <= BROADCAST_BUCKETS else table.hint("merge")


def links(docs: DataFrame, scratch: Scratch, k: int = SHINGLE_WORDS, percent: int = PERCENT, *, class_bits: int | None = None, frequent: tuple[int, int] = FREQUENT, small: int = SMALL, slack: int = SLACK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A row (doc_id, n, cls) per document; one (cls, first, n_copies) per class of equal sets; and links between classes that connect every component."""
    spark = docs.sparkSession
    small_batches(spark)
    tasks = partitions(spark)
    shards = 4 * tasks  # several to a task, so that tasks are of like size
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = scratch.table(map_arrow(docs, _profile(k, percent, shards), "doc_id long, n int, cls long, shard int, counts binary"), "profile")
    profile = both.filter("shard is null").select("doc_id", "n", "cls")
    classes = scratch.table(profile.filter("n > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies")), "classes")
    counts = both.filter("shard is not null").select("shard", "counts").repartition(tasks, "shard")
    maps = spark.sparkContext.broadcast(_classes(counts, class_bits, frequent, scratch))
    index = map_arrow(docs, _index(k, percent, shards, maps, slack), "shard int, entries binary")
    met = map_arrow(index.repartition(tasks, "shard").drop("shard"), _meet(percent, small), "a long, b long, na long, nb long, ra long, rb long, rare long, bucket long")
    met = scratch.table(met, "met")
    pairs = met.filter("bucket is null").groupBy("a", "b").agg(*[F.first(c).alias(c) for c in ("na", "nb", "ra", "rb")], F.sum("rare").alias("rare"))
    # of the prefix that ends first, the rare tokens that the other set lacks must not exceed what a similar pair can lose:
    # r - shared <= n - overlap of the pair, where r = n - overlap of the set + spare; sets with too few rare tokens stay
    enough = F.ceil((F.col("na") + F.col("nb")) * percent / F.lit(100 + percent))
    fits = lambda n, r: (F.col(r) == 0) | (F.col(r) - F.ceil(F.col(n) * percent / F.lit(100)) + enough <= F.col("rare"))
    pairs = pairs.filter(fits("na", "ra") | fits("nb", "rb")).select("a", "b")
    large = met.filter("bucket is not null").select("bucket", F.col("a").alias("cls"))
    # large buckets with the same smallest hash of a member (a min-hash) are mostly alike: together they are one bucket, all
    # of whose members have met that member, and a document is in few of them
    lows = _spread(large.groupBy("bucket").agg(F.min(F.xxhash64("cls")).alias("low")), scratch)
    large = scratch.table(large.join(lows, "bucket").select(F.col("low").alias("bucket"), "cls").distinct(), "large")
    spread = F.pmod(F.xxhash64("cls"), F.lit(LEADERS))
    heads = _spread(large.groupBy("bucket").agg(F.array_compact(F.array(*[F.min(F.when(spread == i, F.col("cls"))) for i in range(LEADERS)])).alias("leaders")), scratch)
    stars = large.join(heads, "bucket").select("cls", F.explode("leaders").alias("lead")).filter("cls != lead").distinct()
    stars = stars.withColumn("rank", F.row_number().over(Window.partitionBy("cls").orderBy("lead"))).filter(F.col("rank") <= LEADERS).select(F.least("cls", "lead").alias("a"), F.greatest("cls", "lead").alias("b"))
    pairs = scratch.table(pairs.union(stars).distinct(), "pairs")
    sets = _sets_of(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("cls")), k, scratch, "sets")
    # a class with many partners is dealt over several tasks by salt
    wide = pairs.groupBy("a").agg((F.count("*") / PARTNERS).cast("int").alias("salts"))
    salted = pairs.join(wide, "a").select("a", F.pmod(F.hash("b"), F.col("salts") + 1).alias("salt"), "b")
    partners = salted.join(sets.withColumnRenamed("cls", "b"), "b").select("a", "salt", "b", "tokens")
    own = wide.join(sets.withColumnRenamed("cls", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), "salts")).alias("salt"), F.lit(None).cast("long").alias("b"), "tokens")
    dealt = own.union(partners).repartition(tasks, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    edges = scratch.table(map_arrow(dealt, _verify(percent), "a long, b long"), "edges")
    if large.isEmpty():
        return profile, classes, edges
    # what stars can't settle: buckets whose members are still in several components. Of two such members one at least
    # is outside the bucket's largest component; those outside meet every block of the bucket
    comp = components(edges, scratch, "near")
    members = large.join(comp, large.cls == comp.v, "left").select("bucket", "cls", F.coalesce("m", "cls").alias("comp"))
    members = scratch.table(members, "members")
    of = members.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    open_ = of.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("size"), F.count("*").alias("comps")).filter("comps > 1")
    open_ = scratch.table(open_.select("bucket", F.col("top.comp").alias("most"), ((F.col("size") + BLOCK - 1) / BLOCK).cast("int").alias("blocks"), ((F.col("size") - F.col("top.n") + ASKING - 1) / ASKING).cast("int").alias("parts")), "open")
    if open_.isEmpty():
        return profile, classes, edges
    members = members.join(_spread(open_, scratch), "bucket")
    part = lambda n: F.pmod(F.xxhash64("cls"), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sets = _sets_of(docs, classes, members.select("cls"), k, scratch, "block_sets")
    asked = members.filter("comp != most").select("bucket", "cls", "comp", every("blocks").alias("block"), part("parts").alias("part"), F.lit(0).alias("side"))
    cells = members.select("bucket", "cls", "comp", part("blocks").alias("block"), every("parts").alias("part"), F.lit(1).alias("side")).union(asked)
    more = cells.join(sets, "cls").groupBy("bucket", "block", "part").applyInArrow(_block(percent), "a long, b long")
    return profile, classes, scratch.table(edges.union(more), "all_edges")


def jaccard_components(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT, **options) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links of similar sets), and n_copies, the documents of the same set."""
    scratch = Scratch(docs.sparkSession, "ngram_join")
    profile, classes, edges = links(docs, scratch, k, percent, **options)
    comp = components(edges, scratch, "final")
    mine = classes.join(comp, classes.cls == comp.v, "left").select("cls", "first", "n_copies", F.coalesce("m", "cls").alias("comp"))
    mine = scratch.table(mine, "mine")
    low = scratch.table(mine.groupBy("comp").agg(F.min("first").alias("component_id")), "low")
    mine = scratch.table(mine.join(low, "comp").select("cls", "component_id", "n_copies"), "ids")
    empty = F.col("n") == 0
    # rows without a set meet nothing in this join; their keys differ, so that none of them gathers
    key = F.when(empty | F.col("doc_id").isNull(), F.xxhash64("doc_id", F.lit("none"))).otherwise(F.col("cls"))
    out = profile.withColumn("key", key).join(mine.withColumnRenamed("cls", "key"), "key", "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).when(empty, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"), F.when(~empty, F.col("n_copies")).alias("n_copies"))


#: All pairs that share a shingle, and their components.
OP1_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE_WORDS} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {SHINGLE_WORDS} + 2), lambda i: array_to_string(w[i : i + {SHINGLE_WORDS} - 1], ' ')) END) AS g FROM w),
c AS (SELECT doc_id, len(g) AS n, md5(array_to_string(list_sort(g), chr(10))) AS same FROM g),
k AS (SELECT doc_id, n, CASE WHEN n > 0 THEN count(*) OVER (PARTITION BY same) END AS n_copies, min(doc_id) OVER (PARTITION BY same, n > 0 OR NULL) AS first, same FROM c),
s AS (SELECT doc_id, unnest(g) AS x FROM g WHERE doc_id IN (SELECT min(doc_id) FROM c GROUP BY same)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN c x ON a = x.doc_id JOIN c y ON b = y.doc_id WHERE 100 * m >= {PERCENT} * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS v, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON r.v = e.a WHERE r.c < e.b),
t AS (SELECT v, min(c) AS c FROM r GROUP BY 1)
SELECT k.doc_id, k.n AS n_shingles, CASE WHEN k.n = 0 THEN k.doc_id ELSE coalesce(t.c, k.first) END AS component_id, k.n_copies
FROM k LEFT JOIN t ON k.first = t.v
"""


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
