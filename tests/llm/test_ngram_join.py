import itertools
import sys

sys.path.insert(0, __file__.rpartition("/")[0])
import numpy as np
import pytest
from helpers import DOCS, frame, mutated, near_duplicates, prose, seeded, shingles

from quern.llm import ngram_join as op
from quern.llm.graph import forest
from quern.llm.textkit import shingle_sets


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def corpus(r):
    base, line = prose(r, 90), prose(r, 30)
    texts = [mutated(r, base, x) for x in (0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.2) for _ in range(5)]
    texts += [prose(r, 60) + " " + line for _ in range(12)] + [line, line, line + " x"]
    texts += ["", None, " \t ", "one", "one", "One two", "a b c d", "A\tb\nc  d", "a b c d e", "é è ê ë à", "É è ê ë à"]
    return texts


# few documents are frequent here: singles, combinations of two and three, large buckets and blocks all come into play
SETTINGS = [{}, {"frequent": (2, 6), "small": 4}, {"frequent": (1, 2), "small": 3, "slack": 0, "class_bits": 1 << 10}]


@pytest.mark.parametrize("options", SETTINGS)
def test_against_all_pairs(spark, options):
    texts = corpus(seeded(1))
    assert got(op.jaccard_components(frame(spark, texts), **options)) == near_duplicates(list(enumerate(texts)))


def test_chain_of_near_copies(spark):
    r = seeded(5)
    words = prose(r, 80).split(" ")
    texts = []
    for i in range(40):  # each is like its neighbours, the ends have nothing in common
        words[(2 * i) % 80] = prose(r, 1)
        texts.append(" ".join(words))
    want = near_duplicates(list(enumerate(texts)))
    assert got(op.jaccard_components(frame(spark, texts), frequent=(2, 8), small=4)) == want
    assert len({c for _, c in want.values()}) < 10


def test_repeated_rows_and_null_ids(spark):
    rows = [(4, "a b c d e f", *[None] * 7)] * 3 + [(None, "a b c d e f", *[None] * 7), (2, "a b c d e f", *[None] * 7), (9, None, *[None] * 7)]
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()), key=repr)
    assert out == sorted([(4, 2, 2)] * 3 + [(None, 2, None), (2, 2, 2), (9, 0, 9)], key=repr)


def test_empty_table(spark):
    assert op.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_sets_are_whole():
    import pyarrow as pa

    r = seeded(2)
    texts = [prose(r, 3000), "A b", None, "x " * 5000, "\x0bq w\x0ce r t"]
    assert [len(s) for s in shingle_sets(pa.array(texts))] == [len(shingles(t)) for t in texts]
    a, b = shingle_sets(pa.array(["A b c d E", "a B C d\te"]))
    assert a.tolist() == b.tolist()


def test_signatures_cover_similar_sets():
    """Whatever classes the tokens have, similar sets share a signature."""
    r = np.random.default_rng(4)
    for n, trial in itertools.product((3, 8, 20, 60, 200), range(30)):
        x = np.sort(r.choice(1 << 62, n, replace=False).astype(np.uint64))
        lose = r.integers(0, n // 4 + 1)
        y = np.sort(np.concatenate([r.permutation(x)[: n - lose], r.choice(1 << 62, r.integers(0, 2), replace=False).astype(np.uint64)]))
        shared = len(np.intersect1d(x, y))
        if 100 * shared < 75 * (len(x) + len(y) - shared):
            continue
        often, very = r.random(1 << 12) < (0, 0.5, 0.9, 1)[trial % 4], r.random(1 << 12) < 0.5
        maps = [np.packbits(m, bitorder="little") for m in (often, very & often)]
        parts = [op.signatures(s, *maps) for s in (x, y)]
        (a, _, ca), (b, _, cb) = parts
        assert len(np.intersect1d(a, b)) + len(np.intersect1d(ca, cb)) > 0


def test_forest_keeps_components():
    a, b = np.array([5, 1, 9, 7]), np.array([1, 3, 8, 7])
    assert sorted(zip(*(x.tolist() for x in forest(a, b)), strict=True)) == [(3, 1), (5, 1), (9, 8)]


def test_counts_round_trip():
    code, count = np.array([3, 9, 70000, 2**32 - 1], np.uint32), np.array([1, 5, 1, 2])
    c, n = op._unpack_counts(op._pack_counts(code, count))
    assert dict(zip(c.tolist(), n.tolist(), strict=True)) == dict(zip(code.tolist(), count.tolist(), strict=True))
