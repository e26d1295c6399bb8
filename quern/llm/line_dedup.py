"""Line dedup by two Bloom filters: of hashes seen once, and of hashes seen twice.

Each task fills both filters from its lines; the filters of all tasks are merged slice by slice (a
bit set in two tasks' once-filters belongs to the twice-filter). Only lines that the twice-filter
suspects are shuffled, as 128-bit digests with their doc_id, for an exact count of documents and the
choice of the document that keeps them. The filters are sized by the texts' bytes (a bit for each
BYTES_A_BIT, some ten bits a line) unless filter_bits says so, up to MAX_FILTER_BITS, since one of them is broadcast; beyond that
more lines are suspected and shuffled (24 bytes each), and results stay exact. If the confirmed keys are few enough
(broadcast_keys, checked), they are broadcast and the texts stay where they are; otherwise the texts are
joined with the keys that they lose.

A line's key is the line with all of [\\x20\\x09-\\x0D] stripped at both ends and A-Z lower-cased.
Keys of at least min_chars code points found in at least min_docs documents lose all their lines
except in the largest doc_id that holds it.

Defined cases. A null or empty text is one empty line; a null text stays null where it loses none.
Rows are documents: repeated rows count each, and those of the largest doc_id all keep the line. A
null doc_id is never the largest. All columns of the input are returned, in their order, and then
__n_lines and __n_dropped, which get underscores appended where the input has such columns; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, free_names, map_arrow, partitions, small_batches
from .textkit import IS_WS, LOWER, chunks, hash_runs, mix64

MIN_CHARS, MIN_DOCS = 40, 5
#: Bytes of text for which a filter gets a bit, and its limits; a task holds two packed filters of at most 128 MB.
BYTES_A_BIT, MIN_FILTER_BITS, MAX_FILTER_BITS = 8, 1 << 16, 1 << 30
SLICES = 64
#: Repeated keys up to which they are broadcast (24 bytes each) and no text is shuffled; beyond, texts are joined with their drops.
BROADCAST_KEYS = 1 << 18
_LOWER = LOWER.tobytes()
_SPACE = bytes(np.flatnonzero(IS_WS).tolist())


def long_keys(raw: np.ndarray, offsets: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, first byte, byte after the last) of each key that is long enough."""
    newline = np.flatnonzero(raw == 10)
    first = np.sort(np.concatenate([offsets[:-1], newline + 1]))
    last = np.sort(np.concatenate([newline, offsets[1:]]))
    ink = np.flatnonzero(~IS_WS[raw])
    i, j = np.searchsorted(ink, first), np.searchsorted(ink, last) - 1
    some = i <= j
    first, last = ink[i[some]], ink[j[some]] + 1
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    long_ = points[last] - points[first] >= min_chars
    first, last = first[long_], last[long_]
    if not len(first):
        return first, np.zeros(0, np.uint64), first, last
    length = last - first
    head = np.cumsum(length) - length
    kept = raw[np.arange(int(length.sum())) + np.repeat(first - head, length)]
    return np.searchsorted(offsets, first, "right") - 1, hash_runs(kept, head, length), first, last


def _once_each(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Indexes of the first line of each (text, key)."""
    order = np.lexsort((hashes, text))
    t, h = text[order], hashes[order]
    return order[np.append(True, (t[1:] != t[:-1]) | (h[1:] != h[:-1]))] if len(order) else order


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes % np.uint64(bits)).astype(np.int64), (mix64(hashes) % np.uint64(bits)).astype(np.int64)


def _holds(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Are both bits of each hash set in a packed filter?"""
    out = np.ones(len(hashes), bool)
    for at in _places(hashes, 8 * len(packed)):
        out &= (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out


def _set(packed: np.ndarray, *places: np.ndarray) -> None:
    """Set bits of a packed filter."""
    at = np.unique(np.concatenate(places))
    if len(at):
        byte = at >> 3
        first = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
        packed[byte[first]] |= np.bitwise_or.reduceat((128 >> (at & 7)).astype(np.uint8), first)


def bits_for(n_bytes: int) -> int:
    """Bits of a filter for texts of that many bytes: a power of two."""
    return min(MAX_FILTER_BITS, max(MIN_FILTER_BITS, 1 << (n_bytes // BYTES_A_BIT).bit_length()))


def _fill(bits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for _, _, raw, offsets in chunks(batch.column(0)):
                text, hashes, _, _ = long_keys(raw, offsets, min_chars)
                hashes, count = np.unique(hashes[_once_each(text, hashes)], return_counts=True)
                a, b = _places(hashes, bits)
                again = (count > 1) | _holds(once, hashes)
                _set(twice, a[again], b[again])
                _set(once, a, b)
        step = bits // 8 // SLICES
        for s in range(SLICES):
            part = [x[s * step : (s + 1) * step] for x in (once, twice)]
            if part[0].any():
                yield {"slice": [s], "once": [zlib.compress(part[0], 1)], "twice": [zlib.compress(part[1], 1)]}

    return run


def _merge(bits: int):
    """The twice-filter's slices; all rows of a slice are in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for s, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                if s not in held:
                    held[s] = [a.copy(), b.copy()]
                else:
                    once, twice = held[s]
                    twice |= b | (once & a)
                    once |= a
        for s, (_, twice) in held.items():
            yield {"slice": [s], "twice": [zlib.compress(twice.tobytes(), 1)]}

    return run


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _suspects(filter_, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for start, _, raw, offsets in chunks(batch.column(1)):
                text, hashes, first, last = long_keys(raw, offsets, min_chars)
                hit = _holds(filter_.value, hashes)
                text, hashes, first, last = text[hit], hashes[hit], first[hit], last[hit]
                one = _once_each(text, hashes)
                if len(one):
                    kept = LOWER[raw].tobytes()
                    keys = [digest(kept[i:j]) for i, j in zip(first[one].tolist(), last[one].tolist(), strict=True)]
                    yield {"key": keys, "doc_id": batch.column(0).take(pa.array(text[one] + start))}

    return run


def _without(text: str, gone: set[bytes], min_chars: int) -> tuple[str, int]:
    """The text without the lines whose digests are gone, and their number."""
    lines = text.split("\n")
    kept = []
    for line in lines:
        if len(line) >= min_chars:
            key = line.encode().strip(_SPACE).translate(_LOWER)
            if digest(key) in gone and len(key.decode()) >= min_chars:
                continue
        kept.append(line)
    return "\n".join(kept), len(lines) - len(kept)


def _result(batch: pa.RecordBatch, names: list[str], at: int, gone: dict[int, set[bytes]], min_chars: int) -> dict:
    """The batch with the lines dropped that gone has for some of its rows, and the counts of lines."""
    texts = batch.column(at)
    n_dropped = np.zeros(len(texts), np.int64)
    n_lines = pa.compute.add(pa.compute.count_substring(texts.fill_null(""), "\n"), 1)
    if gone:
        new = texts.to_pylist()
        for i, keys in gone.items():
            new[i], n_dropped[i] = _without(new[i] or "", keys, min_chars)
        texts = pa.array(new, texts.type)
    return {n: texts if i == at else batch.column(i) for i, n in enumerate(names)} | {"__n_lines": n_lines, "__n_dropped": n_dropped}


def _drop(names: list[str], at: int, min_chars: int):
    """Texts without the dropped lines. The last column holds the digests to drop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            drops = batch.column(batch.num_columns - 1)
            hit = np.flatnonzero(drops.is_valid().to_numpy(zero_copy_only=False)).tolist()
            yield _result(batch, names, at, {i: {bytes(x) for x in drops[i].as_py()} for i in hit}, min_chars)

    return run


def _drop_known(names: list[str], at: int, own: int, filter_, repeated, min_chars: int):
    """The same, where the repeated keys and the doc_ids that keep them were broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        last_of = repeated.value
        for batch in batches:
            ids = batch.column(own).to_pylist()
            gone: dict[int, set[bytes]] = {}
            for start, _, raw, offsets in chunks(batch.column(at)):
                text, hashes, first, last = long_keys(raw, offsets, min_chars)
                kept = LOWER[raw].tobytes()
                for k in np.flatnonzero(_holds(filter_.value, hashes)).tolist():
                    key, i = digest(kept[first[k] : last[k]]), int(text[k]) + start
                    if key in last_of and ids[i] != last_of[key]:
                        gone.setdefault(i, set()).add(key)
            yield _result(batch, names, at, gone, min_chars)

    return run


def dedup_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, filter_bits: int | None = None, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """The documents with repeated lines dropped, and two more columns, the last: __n_lines (before) and __n_dropped."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "line_dedup")
    texts = docs.select(F.col("text").cast("string").alias("text"))
    bits = filter_bits or bits_for(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    slices = map_arrow(texts, _fill(bits, min_chars), "slice int, once binary, twice binary")
    merged = map_arrow(slices.repartition(min(SLICES, partitions(spark)), "slice"), _merge(bits), "slice int, twice binary")
    step = bits // 8 // SLICES
    twice = np.zeros(bits // 8, np.uint8)
    for row in merged.collect():  # SLICES rows, bits / 8 bytes before compression
        twice[row.slice * step : (row.slice + 1) * step] = np.frombuffer(zlib.decompress(row.twice), np.uint8)
    filter_ = spark.sparkContext.broadcast(twice)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    suspects = scratch.table(map_arrow(keyed, _suspects(filter_, min_chars), "key binary, doc_id long"), "suspects")
    # written, so that the join below reads both sides anew and can split a key that a third of all documents hold
    repeated = suspects.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).filter(F.col("n") >= min_docs).select("key", "last")
    repeated = scratch.table(repeated, "repeated")
    names = docs.columns
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at, own = names.index("text"), names.index("doc_id")
    schema = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes)) + ", __n_lines long, __n_dropped long"
    few = repeated.limit(broadcast_keys + 1)
    if few.count() <= broadcast_keys:
        known = spark.sparkContext.broadcast({bytes(r.key): r["last"] for r in repeated.collect()})  # at most broadcast_keys rows
        out = map_arrow(numbered, _drop_known(numbered.columns, at, own, filter_, known, min_chars), schema)
    else:
        drops = suspects.join(repeated, "key").filter(~F.col("doc_id").eqNullSafe(F.col("last")))
        drops = drops.groupBy(F.col("doc_id").alias("__drop_id")).agg(F.collect_set("key").alias("__drops"))
        drops = scratch.table(drops, "drops")
        joined = numbered.join(drops, F.col(f"c{own}").cast("long").eqNullSafe(drops["__drop_id"]), "left").drop("__drop_id")
        out = map_arrow(joined, _drop(numbered.columns, at, min_chars), schema)
    return out.toDF(*names, *free_names(names, "__n_lines", "__n_dropped"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP10_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
j AS (SELECT k.doc_id, k.i, k.line, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
