"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages (runs of PASSAGE_WORDS words, the last one shorter). Each passage is
encoded from the shares of its byte classes, its word lengths and its repeated words; a gated
attention, softmax(w . (tanh(V e) * sigmoid(U e))), learned from document labels alone, weighs the
encodings, and a logistic layer scores the weighted sum. It is fitted in numpy on a bounded sample of
labelled rows (per_class rows of each label), with balanced classes and fixed seeds.

Defined cases. A null, empty or wordless text is one empty passage and is scored like any other.
Without labels to learn from, every score is 0.5. Rows are scored one by one, so repeated rows are
alike. Labels that disagree on a doc_id count each. Further columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sampling import bounded_sample, held_out
from .shared import free_names, map_arrow, small_batches
from .textkit import CHUNK_BYTES, IS_WS, chunks, hash_runs

PER_CLASS, PASSAGE_WORDS, THRESHOLD = 400, 64, 0.7
HIDDEN, EPOCHS, RATE, DECAY = 24, 150, 0.03, 1e-4

#: A class for each ASCII sign that isn't a letter or digit, and for capitals, small letters, digits, controls, other bytes.
_SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]
BYTE_CLASS = np.zeros(256, np.int64)
BYTE_CLASS[65:91], BYTE_CLASS[97:123], BYTE_CLASS[48:58] = 1, 2, 3
BYTE_CLASS[128:] = 4
BYTE_CLASS[_SIGNS] = np.arange(5, 5 + len(_SIGNS))
N_CLASSES = 5 + len(_SIGNS)
N_FEATURES = N_CLASSES + 5


def passages(texts: pa.Array, words: int = PASSAGE_WORDS, size: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features of passages, passages of each text), chunk by chunk."""
    for _, _, raw, offsets in chunks(texts, size):
        ink = np.flatnonzero(~IS_WS[raw])
        cut = np.zeros(len(raw) + 1, bool)
        cut[offsets] = True
        first = np.append(True, ink[1:] != ink[:-1] + 1)[: len(ink)] | cut[ink]
        head = np.flatnonzero(first)
        length = np.diff(np.append(head, len(ink)))
        text = np.searchsorted(offsets, ink[head], "right") - 1
        n_words = np.bincount(text, minlength=len(offsets) - 1)
        n_pass = np.maximum(1, -(-n_words // words))
        start = np.cumsum(n_pass) - n_pass
        place = np.arange(len(head)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
        own = start[text] + place // words  # passage of each word
        total = int(n_pass.sum())
        counts = np.bincount(np.repeat(own, length) * N_CLASSES + BYTE_CLASS[raw[ink]], minlength=total * N_CLASSES).reshape(total, N_CLASSES).astype(np.float64)
        size_ = np.maximum(counts.sum(axis=1), 1)
        n = np.maximum(np.bincount(own, minlength=total), 1)
        more = np.zeros((total, 5))
        more[:, 2] = size_ / n / 10  # mean length; of no word, as of one letter
        if len(head):
            h = hash_runs(raw[ink], head, length)
            order = np.lexsort((h, own))
            new = np.append(True, (own[order][1:] != own[order][:-1]) | (h[order][1:] != h[order][:-1]))
            more[:, 0] = np.bincount(own[order][new], minlength=total) / n  # different words
            at = np.flatnonzero(new)
            np.maximum.at(more[:, 1], own[order][at], np.diff(np.append(at, len(order))))
            more[:, 1] /= n  # share of the most frequent word
            single = np.bincount(own, weights=length == 1, minlength=total)
            more[:, 3] = single / n
        more[:, 4] = np.log1p(np.bincount(own, minlength=total)) / 4
        yield np.concatenate([np.sqrt(counts / size_[:, None]), more], axis=1), n_pass


class Attention:
    """The network's weights; forward and, for fitting, backward over bags of passages."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        scale = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {"W": scale(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": scale(HIDDEN, HIDDEN), "U": scale(HIDDEN, HIDDEN), "w": scale(HIDDEN), "c": scale(HIDDEN), "d": np.zeros(1)}
        self.mean, self.std = np.zeros(N_FEATURES), np.ones(N_FEATURES)

    def forward(self, x: np.ndarray, n: np.ndarray) -> dict:
        p, start = self.p, np.cumsum(n) - n
        x = (x - self.mean) / self.std
        e = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(e @ p["V"]), 1 / (1 + np.exp(-(e @ p["U"])))
        score = (t * s) @ p["w"]
        top = np.repeat(np.maximum.reduceat(score, start), n)
        a = np.exp(score - top)
        a /= np.repeat(np.add.reduceat(a, start), n)
        z = np.add.reduceat(a[:, None] * e, start)
        return {"x": x, "e": e, "t": t, "s": s, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -50, 50)))}

    def gradients(self, f: dict, n: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        p, start = self.p, np.cumsum(n) - n
        do = weight * (f["p"] - y)
        dz = np.repeat(do, n)[:, None] * p["c"]
        da = (f["e"] * dz).sum(axis=1)
        dl = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, start), n))
        dg = dl[:, None] * p["w"]
        dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
        de = (f["a"][:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["e"] ** 2)
        return {"W": f["x"].T @ de, "b": de.sum(axis=0), "V": f["e"].T @ dt, "U": f["e"].T @ ds, "w": (f["t"] * f["s"]).T @ dl, "c": f["z"].T @ do, "d": do.sum(keepdims=True)}

    def fit(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> Attention:
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 0.02
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for step in range(1, EPOCHS + 1):
            for k, g in self.gradients(self.forward(x, n), n, y, weight).items():
                g = g + DECAY * self.p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                self.p[k] = self.p[k] - RATE * (1 - step / (EPOCHS + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def scores(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.forward(x, n)["p"]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        at = 0
        for x, n in passages(batch.column(1)):
            bags = np.split(x, np.cumsum(n)[:-1])
            yield {"label": batch.column(0).slice(at, len(n)), "doc_id": batch.column(2).slice(at, len(n)), "bag": [b.astype(np.float32).tobytes() for b in bags]}
            at += len(n)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Attention | None:
    """docs: doc_id, text. labels: doc_id, quality (0, 1 or null). The driver gets about 0.2 KB for each passage of the sampled rows."""
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    sample = bounded_sample(known, "quality", per_class)
    rows = F.broadcast(sample).join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id").select("quality", "text", "doc_id")  # at most 2 * per_class rows are broadcast
    found = sorted(map_arrow(rows, _bags, "label int, doc_id long, bag binary").collect(), key=lambda r: (r.doc_id, r.label, r.bag))
    if len({r.label for r in found}) < 2:
        return None
    bags = [np.frombuffer(r.bag, np.float32).reshape(-1, N_FEATURES).astype(np.float64) for r in found]
    return Attention().fit(np.concatenate(bags), np.array([len(b) for b in bags]), np.array([r.label for r in found], np.float64))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        m: Attention | None = model.value
        for batch in batches:
            at = 0
            for x, n in passages(batch.column(1), size=1 << 20):
                score = np.full(len(n), 0.5) if m is None else m.scores(x, n)
                yield {"doc_id": batch.column(0).slice(at, len(n)), "score": score} | {f"c{i}": batch.column(2 + i).slice(at, len(n)) for i in range(batch.num_columns - 2)}
                at += len(n)

    return run


def score(docs: DataFrame, model: Attention | None, keep: list[str] | None = None) -> DataFrame:
    """doc_id and score of every text; with columns to keep, __doc_id and __score (underscores appended where taken) and then those."""
    small_batches(docs.sparkSession)
    keep = keep or []
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[F.col(f"`{c}`") for c in keep]).toDF("doc_id", "text", *[f"c{i}" for i in range(len(keep))])
    kinds = dict(docs.dtypes)
    out = map_arrow(rows, _score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double" + "".join(f", c{i} {kinds[c]}" for i, c in enumerate(keep)))
    return out.toDF(*free_names(keep, "__doc_id", "__score"), *keep) if keep else out


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
