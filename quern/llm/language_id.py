"""Language ID by string kernels.

The kernel of two texts is the number of byte n-grams of 1 to 3 bytes (blended spectrum) that both
hold, hashed into a fixed number of places and normalised: a presence kernel. A Nyström map over
landmark texts and one-versus-rest kernel ridge regression are fitted on a bounded sample of labelled
rows (per_class rows of each language, LANDMARKS of them as landmarks), in numpy. Whole texts are
scored in batches by two matrix products.

The scores say which class is nearest, not whether any is near: they sum to a constant, so the best is
high for noise as well. Near is a text of which enough places of three bytes are known, that is, held
by two or more sampled rows of its class. Enough is half of the median over these rows, each judged by
the others, whatever the number of classes. A class of one or two rows knows nothing and rejects nothing.

Defined cases. A null text, one without a letter, or one not near its class (random letters, another
script) is und with score 0; it is also what every text gets if no row has a language to learn from. Rows are judged one by one, so repeated rows are alike.
Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sampling import bounded_sample, held_out
from .shared import free_names, map_arrow, small_batches
from .textkit import LOWER, chunks

PER_CLASS, LANDMARKS, RIDGE = 256, 128, 1e-3
#: Places of n-grams of one, two and three bytes.
PLACES = (256, 4096, 8192)
UNKNOWN = "und"
#: So many places are taken as known of any text, as a few say little.
SLACK = 8
_PLAIN = LOWER.copy()
_PLAIN[[c for c in range(128) if not chr(c).isalpha()]] = 32


def presence(texts: pa.Array) -> Iterator[np.ndarray]:
    """Matrices of 0 and 1, a row per text: which n-grams it holds."""
    for first, last, raw, offsets in chunks(texts, 1 << 20):
        for a in range(0, last - first, 256):
            b = min(a + 256, last - first)
            x = _PLAIN[raw[offsets[a] : offsets[b]]].astype(np.uint32)
            size = np.diff(offsets[a : b + 1])
            row = np.repeat(np.arange(b - a) * sum(PLACES), size)
            out = np.zeros((b - a, sum(PLACES)), np.float32)
            flat = out.reshape(-1)
            # where an n-gram would cross into the next text
            left = np.repeat(offsets[a + 1 : b + 1] - offsets[a], size) - np.arange(len(x))
            code, base = x, 0
            for n, places in enumerate(PLACES):
                if n:
                    if len(x) <= n:
                        break
                    code = code[:-1] * np.uint32(256) + x[n:]
                    inside = left[: len(code)] > n
                    at = (code[inside] * np.uint32(2654435761)) >> np.uint32(32 - int(places).bit_length() + 1)
                    flat[row[: len(code)][inside] + base + at] = 1
                else:
                    flat[row + code] = 1
                base += places
            yield out


def _telling() -> np.ndarray:
    """Which places of three bytes count: not those of a single letter between what is no letter, which any text holds."""
    seen = np.unique(_PLAIN).astype(np.uint32)
    other = np.uint32(32)
    codes = np.concatenate([(a * np.uint32(256) + b) * np.uint32(256) + c for a, b, c in ((seen, other, other), (other, seen, other), (other, other, seen))])
    out = np.ones(PLACES[2], np.float32)
    out[(codes * np.uint32(2654435761)) >> np.uint32(32 - PLACES[2].bit_length() + 1)] = 0
    return out


class KernelModel:
    """Scores = normalised kernel with the landmarks, times weights."""

    def __init__(self, grams: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.classes = sorted(set(labels))
        # landmarks: the first rows of each class in turn (rows come in the order of their hashes)
        rank = {c: 0 for c in self.classes}
        order = []
        for i, c in enumerate(labels):
            order.append((rank[c], i))
            rank[c] += 1
        chosen = [i for _, i in sorted(order)[:landmarks]]
        self.landmarks = np.ascontiguousarray(grams[chosen].T)
        self.norms = np.sqrt(np.maximum(grams[chosen].sum(axis=1), 1))
        among = self._kernel(grams[chosen])
        values, vectors = np.linalg.eigh((among + among.T) / 2)
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        mapped = np.column_stack([self._kernel(grams) @ root, np.ones(len(grams))])
        target = np.where(np.array(labels)[:, None] == np.array(self.classes)[None], 1.0, -1.0)
        weights = np.linalg.solve(mapped.T @ mapped + ridge * len(grams) * np.eye(mapped.shape[1]) / mapped.shape[1], mapped.T @ target)
        self.weights, self.bias = (root @ weights[:-1]).astype(np.float64), weights[-1]
        threes, of, telling = grams[:, -PLACES[2] :], np.array(labels), _telling()
        self.known, self.least = np.zeros((PLACES[2], len(self.classes) + 1), np.float32), np.zeros(len(self.classes))
        self.known[:, -1] = telling
        for k, c in enumerate(self.classes):
            own = threes[of == c] * telling
            held = own.sum(axis=0)
            self.known[:, k] = held >= 2
            self.least[k] = np.median((own * (held - own >= 2)).sum(axis=1) / np.maximum(own.sum(axis=1), 1)) / 2

    def near(self, grams: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Whether texts are near the classes that score best."""
        held = grams[:, -PLACES[2] :] @ self.known
        return (held[np.arange(len(grams)), best] + SLACK) / (held[:, -1] + SLACK) >= self.least[best]

    def _kernel(self, grams: np.ndarray) -> np.ndarray:
        own = np.sqrt(np.maximum(grams.sum(axis=1, dtype=np.float64), 1))
        return (grams @ self.landmarks).astype(np.float64) / own[:, None] / self.norms[None]

    def scores(self, grams: np.ndarray) -> np.ndarray:
        return self._kernel(grams) @ self.weights + self.bias


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        at = 0
        for m in presence(batch.column(1)):
            yield {"lang": batch.column(0).slice(at, len(m)), "doc_id": batch.column(2).slice(at, len(m)), "grams": [x.tobytes() for x in np.packbits(m > 0, axis=1)]}
            at += len(m)


def fit(docs: DataFrame, per_class: int = PER_CLASS) -> KernelModel | None:
    """docs: doc_id, text, lang; only rows that aren't held out are learned from. The driver gets 1.6 KB for each sampled row."""
    rows = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("lang", "text", "doc_id")
    sample = map_arrow(bounded_sample(rows, "lang", per_class), _grams, "lang string, doc_id long, grams binary")
    found = sorted(sample.collect(), key=lambda r: (zlib_hash(r.doc_id), r.doc_id))
    if not found:
        return None
    grams = np.unpackbits(np.stack([np.frombuffer(r.grams, np.uint8) for r in found]), axis=1)[:, : sum(PLACES)].astype(np.float32)
    return KernelModel(grams, [r.lang for r in found])


def zlib_hash(doc_id: int) -> int:
    import zlib

    return zlib.crc32(f"{doc_id}/".encode())


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        m: KernelModel | None = model.value
        for batch in batches:
            at = 0
            for grams in presence(batch.column(1)):
                n = len(grams)
                letters = batch.column(2).slice(at, n).fill_null(False).to_numpy(zero_copy_only=False)
                if m is None:
                    lang, score = [UNKNOWN] * n, np.zeros(n)
                else:
                    s = m.scores(grams)
                    best = s.argmax(axis=1)
                    letters = letters & m.near(grams, best)
                    score = np.where(letters, np.clip((s[np.arange(n), best] + 1) / 2, 0, 1), 0.0)
                    lang = [m.classes[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                yield {"doc_id": batch.column(0).slice(at, n), "lang_pred": lang, "score": score} | {f"c{i}": batch.column(3 + i).slice(at, n) for i in range(batch.num_columns - 3)}
                at += n

    return run


def identify(docs: DataFrame, model: KernelModel | None, keep: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred and score of every text; with columns to keep, __doc_id, __lang_pred and __score (underscores appended where taken) and then those."""
    small_batches(docs.sparkSession)
    keep = keep or []
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("text").rlike(r"\p{L}"), *[F.col(f"`{c}`") for c in keep]).toDF("doc_id", "text", "letters", *[f"c{i}" for i in range(len(keep))])
    kinds = dict(docs.dtypes)
    out = map_arrow(rows, _score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, lang_pred string, score double" + "".join(f", c{i} {kinds[c]}" for i, c in enumerate(keep)))
    return out.toDF(*free_names(keep, "__doc_id", "__lang_pred", "__score"), *keep) if keep else out


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
