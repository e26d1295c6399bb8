"""SentencePiece models run by the tokenizers library.

The model protobuf is parsed here (pieces with scores and types, trainer and normalizer settings).
The normalizer is rebuilt (character map, extra white space, dummy prefix, the marker for spaces),
unigram models from their scores and BPE models from merges that the scores imply, with byte fallback.
Parity with the sentencepiece library is verified for every text of the column.

Texts are cut before runs of the marker where no piece of the model joins a cut (checked on the
vocabulary); each different cut part is encoded once, in batches that the library spreads over its
threads (RAYON_NUM_THREADS), and remembered if it comes again. Otherwise whole texts are encoded.

Defined cases. A null text is empty and has no ids. Very long texts are encoded whole. Rows are
encoded one by one, so repeated rows are alike. Further columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_arrow, small_batches

MARK = "▁"
#: Types of pieces, and of models, in the protobuf.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Parts that one worker remembers the ids of: the first that come again, so the frequent ones.
MEMORY = 500_000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message: int, bytes, or the four or eight bytes of fixed types."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} isn't expected")
        yield key >> 3, value


class Model:
    """What the protobuf says."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normalizer = {}, {}
        for number, value in fields(data):
            if number == 1:
                x = dict(fields(value))
                self.pieces.append((x[1].decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        if trainer.get(24, 0):
            raise ValueError("models with the marker as a suffix aren't read")
        self.charsmap = normalizer.get(2, b"")
        self.prefix, self.squeeze, self.escape = (bool(normalizer.get(i, 1)) for i in (3, 4, 5))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def build(model: Model):
    """The tokenizers.Tokenizer of a model, without a pre-tokenizer."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    if model.kind == UNIGRAM:
        worst = min((s for _, s, t in model.pieces if t == NORMAL), default=0.0)
        # control and unused pieces never match text; their scores put them out of reach
        vocab = [(p, s if t in (NORMAL, USER) else (worst - 1e6 if t in (CONTROL, UNUSED) else s)) for p, s, t in model.pieces]
        tokenizer = Tokenizer(models.Unigram(vocab, model.unknown, model.byte_fallback))
    elif model.kind == BPE:
        ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        usable = {p for p, _, t in model.pieces if t in (NORMAL, USER)}
        merges = []
        for p, s, t in model.pieces:
            if t == NORMAL and len(p) > 1:
                merges += [(-s, ids[p[:i]], ids[p[i:]], p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]
        merges.sort(key=lambda m: m[:3])
        tokenizer = Tokenizer(models.BPE(ids, [m[3:] for m in merges], unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback))
    else:
        raise ValueError("only unigram and BPE models are read")
    user = [AddedToken(p, normalized=False) for p, _, t in model.pieces if t == USER]
    if user:
        tokenizer.add_tokens(user)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.prefix else [])])
    return tokenizer


class Backend:
    """Encodes and decodes batches."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        with open(path, "rb") as f:
            self.model = Model(f.read())
        self.tokenizer = build(self.model)
        # parts come normalised: the same model without a normalizer
        self.parts = Tokenizer.from_str(self.tokenizer.to_str())
        self.parts.normalizer = normalizers.Sequence([])
        joined = any(re.search(f"[^{MARK}]{MARK}", p) for p, _, t in self.model.pieces if t in (NORMAL, USER))
        self.split = not joined and not any(t == USER for _, _, t in self.model.pieces) and self.model.escape
        self.simple = not self.model.charsmap and not self.model.squeeze
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.marked = np.array([t in (NORMAL, USER) and p.startswith(MARK) for p, _, t in self.model.pieces])
        self.seen = np.zeros(1 << 22, bool)
        self.known: dict[str, int] = {}
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def normalized(self, text: str) -> str:
        if self.simple:
            return ((" " if self.model.prefix and text else "") + text).replace(" ", MARK) if self.model.escape else text
        return self.tokenizer.normalizer.normalize_str(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.split:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        parts = [self.cut.findall(self.normalized(t)) for t in texts]
        flat = [p for part in parts for p in part]
        at = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        start, ids = self.start, self.ids
        missed = np.flatnonzero(at < 0)
        new: dict[str, int] = {}
        if len(missed):
            number = np.fromiter((new.setdefault(flat[i], len(new)) for i in missed.tolist()), np.int64, len(missed))
            plain = [w for w in new if w.rfind(MARK) == 0 and len(w) > 1]
            rest = [w for w in new if w.rfind(MARK) != 0 or len(w) == 1]
            order = np.empty(len(new), np.int64)
            order[[new[w] for w in plain] + [new[w] for w in rest]] = np.arange(len(new))
            at[missed] = len(start) - 1 + order[number]
            # parts with one marker, at their front, are encoded many to a line: their first tokens alone hold markers
            lines = ["".join(plain[a : a + 48]) for a in range(0, len(plain), 48)]
            found = [e.ids for e in self.parts.encode_batch_fast(lines + rest, add_special_tokens=False)]
            joined = np.concatenate([np.array(f, np.uint32) for f in found[: len(lines)]] or [np.zeros(0, np.uint32)])
            first = np.flatnonzero(self.marked[joined])
            if len(first) != len(plain):
                raise RuntimeError("a marker was lost")
            sizes = np.concatenate([np.diff(np.append(first, len(joined))), np.fromiter(map(len, found[len(lines) :]), np.int64, len(rest))])
            new = dict.fromkeys(plain + rest, 0)
            start = np.concatenate([start, start[-1] + np.cumsum(sizes)])
            ids = np.concatenate([ids, joined, *(np.array(f, np.uint32) for f in found[len(lines) :])])
        size = start[at + 1] - start[at]
        ends = np.cumsum(size)
        out = ids[np.arange(int(size.sum())) + np.repeat(start[at] - (ends - size), size)]
        upto = np.concatenate([[0], ends])[np.cumsum([len(p) for p in parts])]
        if new:
            self._remember(list(new), start, ids)
        return np.split(out, upto[:-1])

    def _remember(self, names: list[str], start: np.ndarray, ids: np.ndarray) -> None:
        """Keep those of the new parts that an earlier batch had too."""
        place = np.fromiter(map(hash, names), np.int64, len(names)) & (len(self.seen) - 1)
        again = np.flatnonzero(self.seen[place])
        self.seen[place] = True
        again = again[: max(0, MEMORY - len(self.known))]
        if len(again):
            n = len(self.start) - 1
            sizes = start[n + again + 1] - start[n + again]
            ends = np.cumsum(sizes)
            self.known.update((names[i], n + j) for j, i in enumerate(again.tolist()))
            self.start = np.concatenate([self.start, self.start[-1] + ends])
            self.ids = np.concatenate([self.ids, ids[np.arange(int(sizes.sum())) + np.repeat(start[n + again] - (ends - sizes), sizes)]])

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of ids; bytes that byte fallback wrote are joined."""
        if not hasattr(self, "surface"):
            # a piece's bytes; the marker is a space
            bytes_ = [bytes([int(p[3:5], 16)]) if t == BYTE else (b"" if t == CONTROL else (" ⁇ " if t == UNKNOWN else p.replace(MARK, " ")).encode()) for p, _, t in self.model.pieces]
            size = np.fromiter(map(len, bytes_), np.int64, len(bytes_))
            self.surface = np.cumsum(size) - size, size, np.frombuffer(b"".join(bytes_), np.uint8)
        first, size, data = self.surface
        out = []
        for x in ids:
            n = size[x]
            ends = np.cumsum(n)
            text = data[np.arange(int(n.sum())) + np.repeat(first[x] - (ends - n), n)].tobytes().decode("utf-8", "replace")
            out.append(text[1:] if self.model.prefix and text.startswith(" ") else text)
        return out


_backends: dict[str, Backend] = {}


def backend(path: str) -> Backend:
    if path not in _backends:
        _backends[path] = Backend(path)
    return _backends[path]


def _run(path: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        import sentencepiece

        own, other = backend(path), sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            ids = own.encode(texts)
            back = own.decode(ids)
            parity = [len(x) == len(y) and x.tolist() == y for x, y in zip(ids, other.encode(texts, num_threads=1), strict=True)]
            out = {"doc_id": batch.column(0), "n_tokens": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids], "decoded": back, "parity": parity}
            yield out | ({"ids": [x.tolist() for x in ids]} if keep else {})

    return run


def encode_column(docs: DataFrame, path: str, *, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded (the text that the ids decode to), parity (with the sentencepiece library), and ids."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, _run(path, ids), "doc_id long, n_tokens long, ids_crc32 long, decoded string, parity boolean" + (", ids array<long>" if ids else ""))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_column(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), ids=False)
    return out.select("doc_id", "n_tokens", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"), "parity")
