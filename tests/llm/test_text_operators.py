import hashlib
import sys
import zlib
from collections import namedtuple

sys.path.insert(0, __file__.rpartition("/")[0])
import numpy as np
import pytest
from helpers import DOCS, deduped_lines, frame, prose, seeded

from pyspark.sql import functions as F

from quern.llm import language_id, line_dedup, media, packing, quality, sentencepiece
from quern.llm.sampling import bounded_sample, held_out

ODD = ["", None, " ", "\n", "a", "é漢🎉 x", "x" * 70000, "two  spaces\t\ttabs \n\n ", "<|endoftext|> <s> ▁", "it's we'll don't", "1234 56,789", "\x00\x1c\x85\xa0"]


# line dedup
def lines(r):
    shared = [prose(r, 12) for _ in range(4)]
    return ["\n".join(r.choice([prose(r, 10), r.choice(shared), "  " + r.choice(shared).upper() + "\t", "short"]) for _ in range(r.randint(1, 9))) for _ in range(60)] + [None, "", "\n", "é" * 39, "é" * 40, *["é" * 40] * 4, *["É" * 40] * 5]


@pytest.mark.parametrize("options", [{}, {"broadcast_keys": 0}, {"filter_bits": 1 << 12}])
def test_line_dedup(spark, options):
    texts = lines(seeded(3))
    out = line_dedup.dedup_lines(frame(spark, texts), **options)
    assert out.columns[:9] == frame(spark, texts).columns
    got = {r.doc_id: (r["__n_lines"], r["__n_dropped"], r.text or "") for r in out.collect()}
    assert got == deduped_lines(list(enumerate(texts)))
    assert sum(x[1] for x in got.values()) > 20


def test_line_filters(spark):
    """A packed filter holds what was put into it, and little else while its size follows the bytes."""
    hashes = line_dedup.mix64(np.arange(20000, dtype=np.uint64))
    bits = line_dedup.bits_for(10000 * 80)
    packed = np.zeros(bits // 8, np.uint8)
    for a in range(0, 10000, 300):
        line_dedup._set(packed, *line_dedup._places(hashes[a : min(a + 300, 10000)], bits))
    assert line_dedup._holds(packed, hashes[:10000]).all()
    assert line_dedup._holds(packed, hashes[10000:]).mean() < 0.05
    plain = np.zeros(bits, bool)
    for at in line_dedup._places(hashes[:10000], bits):
        plain[at] = True
    assert (np.unpackbits(packed).astype(bool) == plain).all()
    assert [line_dedup.bits_for(n) for n in (0, 10**8, 10**15)] == [1 << 16, 1 << 24, 1 << 30]


def test_clashing_names(spark):
    """Columns named like the operators' own stay what they are."""
    names = ["__n_lines", "__n_dropped", "__doc_id", "__lang_pred", "__score", "__drops"]
    docs = spark.createDataFrame([(i, "some words of a text " * 3, "en", *range(6)) for i in range(6)], ["doc_id", "text", "lang", *names])
    lines = line_dedup.dedup_lines(docs)
    assert lines.columns == [*docs.columns, "__n_lines_", "__n_dropped_"] and {(r["__n_lines"], r["__n_lines_"]) for r in lines.collect()} == {(0, 1)}
    assert line_dedup.dedup_lines(docs, broadcast_keys=0).agg(F.sum("__n_dropped_")).first()[0] == 5
    said = language_id.identify(docs, language_id.fit(docs), docs.columns)
    assert said.columns[:3] == ["__doc_id_", "__lang_pred_", "__score_"] and {r["__score"] for r in said.collect()} == {4}
    scored = quality.score(docs, None, docs.columns)
    assert scored.columns[:2] == ["__doc_id_", "__score_"] and {(r["__score"], r["__score_"]) for r in scored.collect()} == {(4, 0.5)}


def test_sample_of_repeated_rows(spark):
    """A label all of whose rows share one key keeps some of them."""
    for key in range(4):
        df = spark.range(5000).select(F.lit(key).alias("doc_id"), F.lit("one").alias("lang")).union(spark.range(3000).select("id", F.lit("two")))
        got = dict(bounded_sample(df, "lang", 20).groupBy("lang").count().collect())
        assert got == {"one": 20, "two": 20}


def test_line_dedup_rows(spark):
    line = "l" * 50
    rows = [(7, line, *[None] * 7)] * 2 + [(i, line + "\nown", *[None] * 7) for i in (1, 2, None)]
    got = sorted((repr(r.doc_id), r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [("1", "own"), ("2", "own"), ("7", line), ("7", line), ("None", "own")]
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


# packing
def plain_tokenizer():
    """A freshly loaded one, which nobody has altered."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def check_sequences(found, capacity=2048):
    """Gapless sequences within the capacity; gives their number."""
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def check_pieces(found, texts):
    library, want = plain_tokenizer(), {}
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) - (-(-len(ids) // 2048) - 1) * 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[i, k] = (a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b])))
    assert len(found) == len(want)
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found} == want


def test_packing(spark):
    r = seeded(6)
    texts = [prose(r, r.choice([1, 5, 40, 300, 2500])) for _ in range(80)] + ODD
    found = packing.pack(frame(spark, texts).repartition(9), packing.tokenizer_path()).collect()
    check_pieces(found, texts)
    assert check_sequences(found) <= 1.1 * sum(r.length for r in found) / 2048 + 2
    assert packing.pack(spark.createDataFrame([], DOCS), packing.tokenizer_path()).count() == 0


@pytest.mark.parametrize(("partitions", "rules"), [(65, packing.Rules()), (211, packing.Rules(fewest=1)), (300, packing.Rules()), (100, packing.Rules(fewest=1, carry=2))])
def test_packing_of_many_partitions(spark, partitions, rules):
    """Several groups meet in a task, and (carry) bins beyond a group's bound are packed by counts."""
    r = seeded(partitions)
    texts = [prose(r, r.choice([1, 5, 40, 60, 100, 200])) for _ in range(partitions * 6)]
    found = packing.pack(frame(spark, texts).repartition(partitions), packing.tokenizer_path(), rules=rules).collect()
    check_pieces(found, texts)
    assert (min(r.sequence_id for r in found) < 0) == (rules.carry == 2)
    n = check_sequences(found)
    assert rules.fewest == 1 or n <= 1.01 * sum(r.length for r in found) / 2048 + 1


def test_merge_of_a_thousand_groups():
    """All rounds of the tree, whose tasks get several groups each; no bin is torn."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(5)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill", "part", "state", "rank"]
    n = 20000
    part = r.integers(0, 1000, n)
    sizes = r.integers(1, 1500, n)
    now = dict(zip(names, [np.arange(n), np.zeros(n), np.zeros(n), sizes, np.zeros(n), np.arange(n), np.zeros(n), sizes, part, np.ones(n), np.zeros(n)], strict=True))
    now = pa.table({k: v.astype(np.int64) for k, v in now.items()})
    done, groups = [], 1000
    while groups > 1:
        groups = -(-groups // packing.FAN_IN)
        task = now["part"].to_numpy() // packing.FAN_IN % 7
        merge = packing._merge(2048, packing.Rules(fewest=1), groups == 1)
        out = [pa.table({k: pa.array(np.asarray(v)) for k, v in x.items()}) for t in range(7) for x in merge(iter(now.filter(pa.array(task == t)).to_batches()))]
        table = pa.concat_tables(out)
        for b in set(table["bin"].to_pylist()) if groups < 20 else []:
            assert len(set(table.filter(pa.compute.equal(table["bin"], b))["part"].to_pylist())) == 1
        open_ = pa.compute.equal(table["state"], packing.NEXT)
        assert not pa.compute.any(pa.compute.equal(table["state"], packing.REST)).as_py()
        done.append((groups, table.filter(pa.compute.invert(open_)) if groups > 1 else table))
        now = table.filter(open_)
    found = [Piece((g, b), o, s) for g, t in done for b, o, s in zip(t["bin"].to_pylist(), t["offset"].to_pylist(), t["length"].to_pylist(), strict=True)]
    assert sorted(p.length for p in found) == sorted(sizes.tolist())
    assert check_sequences(found) <= 1.05 * sizes.sum() / 2048


Piece = namedtuple("Piece", "sequence_id offset length")


@pytest.mark.parametrize("seed", range(12))
def test_plan_by_counts_is_best_fit(seed):
    import numpy as np

    r = np.random.default_rng(seed)
    capacity = int(r.choice([10, 64, 2048]))
    sizes = r.choice(r.integers(1, capacity + 1, 12), int(r.integers(1, 400)))
    counts = dict(zip(*[x.tolist() for x in np.unique(sizes, return_counts=True)], strict=True))
    plan = packing.plan_by_counts(counts, capacity)
    fills, seen = {}, {}
    for size, rank, n, first, k, offset in plan.tolist():
        assert rank == seen.get(size, 0)  # ranks go on without a gap
        seen[size] = rank + n
        for j in range(n):
            b = first + j // k
            assert fills.get(b, 0) == offset + j % k * size
            fills[b] = fills.get(b, 0) + size
    assert seen == counts
    assert sorted(fills.values()) == sorted(packing.best_fit(sizes, capacity)[2].tolist())


def test_encoder_equals_the_library():
    own = packing.Encoder(packing.tokenizer_path())
    texts = [t or "" for t in ODD] + [prose(seeded(1), 500)] * 2 + ["a\n\n b  c", "²½ x_y __a", "tab\tx  y   ", "ñ·x’s", " \n \n", "x\r\ny"]
    for _ in range(3):  # words are remembered from the second time on
        assert [x.tolist() for x in own.encode(texts)] == [plain_tokenizer().encode(t, add_special_tokens=False).ids for t in texts]


def test_best_fit():
    import numpy as np

    where, offset, fills = packing.best_fit(np.array([5, 5, 3, 2, 7]), 10)
    assert sorted(fills.tolist()) == [2, 10, 10] and len(set(zip(where.tolist(), offset.tolist(), strict=True))) == 5


# media
def test_media_round_trip(spark):
    r = seeded(9)
    texts = ODD + ["x" * 191, "x" * 192, "x" * 193, "l" * 600] + ["".join(r.choices("lA\x00é ", k=r.randint(1, 9000))) for _ in range(20)] + ["same", "same"]
    out = {x.doc_id: x for x in media.media_column(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        x = out[i]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert (x.media_bytes, x.media_sha256) == (len(x.media), hashlib.sha256(x.media).hexdigest())
        assert media.payload(*media.decode([bytes(x.media)])[0]) == padded
    assert out[len(texts) - 1].feature == out[len(texts) - 2].feature
    assert media.media_column(spark.createDataFrame([], DOCS)).count() == 0


def test_media_is_baseline_jpeg():
    head = media.parse(media.encode([b"a" * 192 * 70], [5])[0])
    assert (head["width"], head["height"], head["restart"]) == (512, 16, media.RESTART) and head["comment"] == b"payload 13440 text 5"
    with pytest.raises(ValueError, match="SOI"):
        media.decode([b"GIF89a"])
    broken = media.encode([b"a" * 192 * 70], [5])[0].replace(b"\xff\xd0", b"", 1)
    with pytest.raises(ValueError, match="restart"):
        media.decode([broken])


# sentencepiece
def test_sentencepiece(spark):
    import public_tokenizers
    import sentencepiece as library

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = library.SentencePieceProcessor(model_file=path)
    texts = ODD + [prose(seeded(2), 200)] * 3
    out = {r.doc_id: r for r in sentencepiece.encode_column(frame(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        assert out[i].ids == own.encode(t or "") and out[i].parity and out[i].n_tokens == len(out[i].ids)
        if "\x00" not in (t or ""):
            assert out[i].decoded == own.decode(out[i].ids)
    assert sentencepiece.encode_column(spark.createDataFrame([], DOCS), path).count() == 0


def test_unigram_model(tmp_path):
    import struct

    import sentencepiece as library

    def field(number, data):
        if isinstance(data, int):
            return bytes([*varint(number << 3), *varint(data)])
        return bytes([*varint(number << 3 | 2), *varint(len(data))]) + data

    def varint(n):
        out = []
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return [*out, n]

    def piece(text, score, kind=1):
        return field(1, field(1, text.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + field(3, kind))

    pieces = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + b"".join(piece(f"<0x{i:02X}>", 0, 6) for i in range(256))
    pieces += b"".join(piece(p, -s) for p, s in [("▁", 2.0), ("▁a", 2.5), ("b", 3.0), ("ab", 3.5), ("▁ab", 5.9), ("a", 3.2), ("c", 4.0), ("bc", 4.1), ("abc", 9.5)])
    model = pieces + field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 1) + field(5, 1))
    path = tmp_path / "u.model"
    path.write_bytes(model)
    own, other = sentencepiece.Backend(str(path)), library.SentencePieceProcessor(model_file=str(path))
    texts = ["abc ab", "  a  b ", "", "éa", "cab abab bca", "a漢b"]
    assert [x.tolist() for x in own.encode(texts)] == other.encode(texts)
    assert own.decode(own.encode(texts)) == [other.decode(x) for x in other.encode(texts)]


# classifiers
def test_language_id(spark):
    import duckdb

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identify(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").withColumn("held", held_out(F.col("doc_id"))).collect()
    held = [r for r in out if r.held]
    assert len(out) == 1000 and len(held) > 150
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert {r.doc_id for r in held} == {i for (i,) in duckdb.sql("select doc_id from '/root/testdata/sf0.01/documents.parquet'").fetchall() if zlib.crc32(str(i).encode()) % 4 == 2}


def test_language_id_odd_texts(spark):
    texts = ["the cat and the dog are in the house " * 3, "le chat et le chien sont dans la maison " * 3] * 8
    rows = [(i, t, ("en", "fr")[i % 2], *[None] * 6) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.fit(docs)
    out = {r.doc_id: r for r in language_id.identify(frame(spark, ["the dog", "la maison", None, "", "123 ...", "é"]), model).collect()}
    assert [out[i].lang_pred for i in range(5)] == ["en", "fr", "und", "und", "und"] and out[2].score == 0 and out[5].lang_pred in ("en", "fr")
    assert all(0 <= r.score <= 1 for r in out.values())
    assert language_id.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).count() == 0


def test_bounded_sample(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 10 = 0, 'rare', 'often') as lang")
    got = bounded_sample(docs, "lang", 50).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in got} == {"rare": 50, "often": 50}


def test_quality(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").withColumn("held", held_out(F.col("doc_id"))).filter("held").collect()
    assert len(out) > 500 and sum((r.score >= 0.7) == (r.quality == 1) for r in out) / len(out) > 0.97


def test_quality_odd_texts(spark):
    docs = frame(spark, ["Good prose, in order."] * 20 + ["BAD!! ### $$$ STUFF!!"] * 20 + [None, "", "x" * 5000])
    labels = spark.createDataFrame([(i, int(i < 20), 0) for i in range(40)] + [(None, 1, 0), (3, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert all(0 <= s <= 1 for s in out.values()) and len(out) == 43 and min(out[i] for i in range(20)) > max(out[i] for i in range(20, 40))
    assert quality.fit(docs, labels.filter("quality = 1")) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(docs.limit(0), None).count() == 0


def test_attention_gradients():
    import numpy as np

    r = np.random.default_rng(0)
    m, x, n, y = quality.Attention(), r.normal(size=(7, quality.N_FEATURES)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -(y * np.log(p := m.forward(x, n)["p"]) + (1 - y) * np.log(1 - p)).sum()
    g = m.gradients(m.forward(x, n), n, y, np.ones(3))
    for k, i in (("W", (2, 1)), ("V", (0, 3)), ("U", (4, 4)), ("w", (2,)), ("c", (1,)), ("b", (0,))):
        old, e = m.p[k][i], 1e-5
        m.p[k][i] = old + e
        up = loss()
        m.p[k][i] = old - e
        down = loss()
        m.p[k][i] = old
        assert abs((up - down) / (2 * e) - g[k][i]) < 1e-4


def test_language_id_rejects_noise(spark):
    """Noise and texts of another script are und, of two languages and of four; held-out clean texts are not."""
    r = seeded(11)
    words = lambda letters: " ".join("".join(r.choices(letters, k=r.randint(3, 9))) for _ in range(40))
    noise = [words("abcdefghijklmnopqrstuvwxyz") for _ in range(20)] + [words("абвгдежзийклмнопрстуфхцчшщыьэюя") for _ in range(20)] + ["".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(80)) for _ in range(20)] + ["".join(r.choices("0123456789abcdef", k=600)) for _ in range(20)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for some in (docs, docs.filter("lang in ('en', 'de')")):
        model = language_id.fit(some)
        assert {x.lang_pred for x in language_id.identify(frame(spark, noise), model).collect()} == {"und"}
        clean = language_id.identify(some.filter(held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}")), model).collect()
        assert len(clean) > 100 and sum(x.lang_pred == "und" for x in clean) == 0


# classifiers, by plain loops
def plain_grams(text):
    """Places of a text's byte n-grams of 1 to 3 bytes."""
    data = bytes(32 if c < 128 and not chr(c).isalpha() else c for c in (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    out, base = set(), 0
    for n, places in enumerate(language_id.PLACES, 1):
        for i in range(len(data) - n + 1):
            code = int.from_bytes(data[i : i + n], "big")
            out.add(base + (code if n == 1 else (code * 2654435761 & 0xFFFFFFFF) >> 33 - places.bit_length()))
        base += places
    return out


def test_language_scores_by_brute_force():
    import numpy as np
    import pyarrow as pa

    r = seeded(12)
    words = {"aa": ["the", "house", "and", "wood"], "bb": ["der", "Haus", "über", "Wald"], "cc": ["la", "maison", "forêt", "et"]}
    make = lambda c: " ".join(r.choices(words[c], k=r.randint(1, 30)))
    labels = [c for c in words for _ in range(12)]
    texts = [make(c) for c in labels]
    tried = texts[:4] + ODD + [make("bb") * 300, "Ж" * 40]
    sets = [plain_grams(t) for t in tried]
    grams = np.concatenate(list(language_id.presence(pa.array(tried))))
    assert [set(np.flatnonzero(g).tolist()) for g in grams] == sets
    model = language_id.KernelModel(np.concatenate(list(language_id.presence(pa.array(texts)))), labels, 9)
    # the landmarks: the first three texts of each class; ridge regression on the Nyström map, solved anew
    marks = [plain_grams(texts[12 * c + i]) for i in range(3) for c in range(3)]
    kernel = lambda a, b: len(a & b) / (max(1, len(a)) ** 0.5 * max(1, len(b)) ** 0.5)
    among = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(among)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    mapped = lambda of: np.column_stack([np.array([[kernel(plain_grams(t), m) for m in marks] for t in of]) @ root, np.ones(len(of))])
    x, y = mapped(texts), np.array([[1.0 if c == k else -1.0 for k in sorted(words)] for c in labels])
    weights = np.linalg.solve(x.T @ x + language_id.RIDGE * len(x) / x.shape[1] * np.eye(x.shape[1]), x.T @ y)
    assert np.abs(model.scores(grams) - mapped(tried) @ weights).max() < 1e-4


def test_quality_scores_by_brute_force():
    import math

    import numpy as np
    import pyarrow as pa

    r = seeded(13)
    texts = [*ODD, prose(r, 64), prose(r, 65), prose(r, 300), "one one two"]
    model = quality.Attention(3)
    model.mean, model.std = np.linspace(0, 0.3, quality.N_FEATURES), np.linspace(0.5, 1.5, quality.N_FEATURES)

    def features(words):
        data = b"".join(words)
        size, n = max(1, len(data)), max(1, len(words))
        shares = [0.0] * quality.N_CLASSES
        for c in data:
            shares[quality.BYTE_CLASS[c]] += 1
        low = [w.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))) for w in words]
        most = max((low.count(w) for w in low), default=0)
        return [math.sqrt(s / size) for s in shares] + [len(set(low)) / n, most / n, size / n / 10, sum(len(w) == 1 for w in words) / n, math.log1p(len(words)) / 4]

    p = model.p
    for text, got in zip(texts, np.concatenate([model.scores(x, n) for x, n in quality.passages(pa.array(texts))]), strict=True):
        words = (text or "").encode().split()  # bytes split at ASCII white space only
        encoded, attention = [], []
        for k in range(max(1, -(-len(words) // 64))):
            x = (np.array(features(words[64 * k : 64 * k + 64])) - model.mean) / model.std
            e = [math.tanh(sum(x[i] * p["W"][i, j] for i in range(len(x))) + p["b"][j]) for j in range(quality.HIDDEN)]
            gate = [math.tanh(sum(e[i] * p["V"][i, j] for i in range(len(e)))) / (1 + math.exp(-sum(e[i] * p["U"][i, j] for i in range(len(e))))) for j in range(quality.HIDDEN)]
            encoded.append(e)
            attention.append(math.exp(sum(g * w for g, w in zip(gate, p["w"], strict=True))))
        z = [sum(a * e[j] for a, e in zip(attention, encoded, strict=True)) / sum(attention) for j in range(quality.HIDDEN)]
        assert abs(got - 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, p["c"], strict=True)) + p["d"][0])))) < 1e-9


def test_average_hash():
    """The mean of every pixel of a cell counts, by a plain loop; small thumbnails repeat their nearest pixels."""
    r = np.random.default_rng(1)
    for shape in ((1, 1), (3, 9), (8, 8), (20, 31), (8, 64)):
        pixels = r.integers(0, 256, shape).astype(np.uint8)
        at = [[range(i * n // 8, max((i + 1) * n // 8, i * n // 8 + 1)) for i in range(8)] for n in shape]
        cells = [np.mean([int(pixels[y, x]) for y in rows for x in columns]) for rows in at[0] for columns in at[1]]
        middle = np.mean(cells)
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(media.average_hash(pixels)), np.uint8))
        assert all(b == (c > middle) for b, c in zip(bits, cells, strict=True) if abs(c - middle) > 1e-9)


@pytest.mark.parametrize("piece", [8, 24, 1000])
def test_jpeg_in_pieces(monkeypatch, piece):
    """Files are the same, whatever is coded at once; long payloads are cut between intervals only."""
    r = np.random.default_rng(2)
    payloads = [r.integers(0, 256, 192 * n).astype(np.uint8).tobytes() for n in (1, 7, 8, 9, 64, 65, 513)]
    sizes = [len(x) for x in payloads]
    whole = media.encode(payloads, sizes)
    monkeypatch.setattr(media, "PIECE", piece)
    assert media.encode(payloads, sizes) == whole
    assert [media.payload(*x) for x in media.decode(whole)] == payloads
    cells = [5, 8, 100, 1, 16, 40]
    runs = list(media._pieces(cells, piece))
    assert all(sum(b - a for _, a, b in x) <= piece for x in runs)
    for i, n in enumerate(cells):
        own = [x[1:] for run in runs for x in run if x[0] == i]
        assert own[0][0] == 0 and own[-1][1] == n and all(a[1] == b[0] and b[0] % media.RESTART == 0 for a, b in zip(own, own[1:]))
