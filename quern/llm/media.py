"""Media columns: baseline JPEG, written and read in numpy.

A payload is stored losslessly in the format's own unit: each byte, less CENTRE, is one quantised
DCT coefficient (the quantisation table is all ones). An MCU of three 8x8 blocks (Y, Cb, Cr, not
subsampled) takes 192 bytes, in zigzag order. Restart markers after every RESTART MCUs make
intervals that decode independently, and the decoder walks all intervals of a batch of images in
step: one Huffman symbol of every interval per numpy operation. It parses markers (SOF0, DHT, DQT,
DRI, SOS, COM), so tables and dimensions come from the file, not from this module.

Features come from the stored bytes: dimensions, and a hash of the thumbnail that the DC
coefficients of the luminance blocks give (a pixel per block).

Defined cases. A null text is empty and takes 192 padding bytes. Equal texts give equal values. A
text of any length fits: MCUs fill a grid at most GRID wide, and the places left at the end hold
blocks of zeros. Intervals are coded and read in runs of some PIECE MCUs, so that a long text takes
a few bytes of memory for each of its own. Further columns are kept by the operator; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_arrow, small_batches

MCU_BYTES, PAD = 192, 32
CENTRE = 108
RESTART, GRID = 8, 64
#: Payload bytes of texts that are encoded and decoded together, and MCUs that are coded at once, of a longer text too.
BATCH_BYTES = 4 << 20
PIECE = 5 * BATCH_BYTES // 4 // MCU_BYTES

# The zigzag order follows from walking the 8x8 diagonals.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


def _table(symbols: list[tuple[int, int]]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """DHT body (counts, symbols) and code and length by symbol, of (length, symbol) in canonical order."""
    symbols = sorted(symbols, key=lambda x: x[0])
    counts = bytes(sum(n == i for n, _ in symbols) for i in range(1, 17))
    code, last = 0, symbols[0][0]
    codes, lengths = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for n, s in symbols:
        code <<= n - last
        codes[s], lengths[s], last = code, n, n
        code += 1
    return counts + bytes(s for _, s in symbols), codes, lengths


#: Categories of DC differences; and run/size pairs: without zeros before them four bits, with zeros nine.
DC_BODY, DC_CODE, DC_LENGTH = _table([(4, s) for s in range(12)])
AC_BODY, AC_CODE, AC_LENGTH = _table([(4, s) for s in (*range(9), 0xF0)] + [(9, r << 4 | s) for r in range(1, 16) for s in range(1, 9)])
_SIZE = np.array([int(v).bit_length() for v in range(2048)])


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def grid(mcus: int) -> tuple[int, int]:
    """Width and height in MCUs; wider than GRID only where the format's height wouldn't do."""
    wide = min(mcus, GRID)
    while -(-mcus // wide) > 8191:
        wide *= 2
    return wide, -(-mcus // wide)


def _header(n_bytes: int, mcus: int) -> bytes:
    wide, high = grid(mcus)
    frame = struct.pack(">BHHB", 8, 8 * high, 8 * wide, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])
    scan = bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])
    note = f"payload {mcus * MCU_BYTES} text {n_bytes}".encode()
    return b"\xff\xd8" + _marker(0xFE, note) + _marker(0xDB, b"\0" + b"\1" * 64) + _marker(0xC0, frame) + _marker(0xC4, b"\x00" + DC_BODY) + _marker(0xC4, b"\x10" + AC_BODY) + _marker(0xDD, struct.pack(">H", RESTART)) + _marker(0xDA, scan)


def _pieces(cells: list[int], most: int) -> Iterator[list[tuple[int, int, int]]]:
    """Runs of whole intervals, of at most that many cells: (image, first cell, cell after the last)."""
    held, room = [], most
    for i, n in enumerate(cells):
        at = 0
        while at < n:
            end = n if n - at <= room else at + room // RESTART * RESTART
            if end > at:
                held.append((i, at, end))
                room -= end - at
                at = end
            if at < n:
                yield held
                held, room = [], most
    if held:
        yield held


def encode(payloads: list[bytes], n_bytes: list[int]) -> list[bytes]:
    """JPEG files of payloads, each a positive multiple of MCU_BYTES long."""
    mcus = [len(p) // MCU_BYTES for p in payloads]
    cells = [w * h for w, h in map(grid, mcus)]
    files = [[_header(text, m)] for text, m in zip(n_bytes, mcus, strict=True)]
    for piece in _pieces(cells, PIECE):
        coefficients = np.zeros((sum(b - a for _, a, b in piece), 3, 64), np.int64)
        at = 0
        for i, a, b in piece:
            part = np.frombuffer(payloads[i][a * MCU_BYTES : b * MCU_BYTES], np.uint8).reshape(-1, 3, 64)
            coefficients[at : at + len(part)] = part.astype(np.int64) - CENTRE
            at += b - a
        scan, cut = _entropy(coefficients, np.concatenate([np.arange(a, b) for _, a, b in piece]) % RESTART == 0)
        j = 0
        for i, a, b in piece:
            for n in range(a // RESTART, -(-b // RESTART)):  # RST0-7 between the intervals of an image and EOI at its end
                files[i] += [scan[cut[j] : cut[j + 1]], bytes([0xFF, 0xD0 + n % 8]) if (n + 1) * RESTART < cells[i] else b"\xff\xd9"]
                j += 1
    return [b"".join(x) for x in files]


def _entropy(coefficients: np.ndarray, opens: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The coded intervals of some MCUs, and where each starts and the last one ends; opens: the MCUs that start one."""
    dc = coefficients[:, :, 0].copy()
    coefficients[1:, :, 0] = dc[1:] - np.where(opens[1:, None], 0, dc[:-1])
    flat = coefficients.reshape(-1, 64)
    interval = np.repeat(np.cumsum(opens) - 1, 3)
    # symbols: a DC symbol for each block; AC symbols for non-zeros, with ZRL before runs above 15; EOB where a block ends in zeros
    block, k = np.nonzero(np.concatenate([np.ones((len(flat), 1), bool), flat[:, 1:] != 0], axis=1))
    value = flat[block, k]
    before = np.concatenate([[0], k[:-1]])
    run = np.where(k == 0, 0, k - before - 1)
    size = _SIZE[np.abs(value)]
    symbol = np.where(k == 0, size, (run & 15) << 4 | size)
    code = np.where(k == 0, DC_CODE[symbol], AC_CODE[symbol])
    length = np.where(k == 0, DC_LENGTH[symbol], AC_LENGTH[symbol])
    bits = (code << size) | np.where(value < 0, value + (1 << size) - 1, value)
    length = length + size
    if (run > 15).any():
        times = run >> 4
        at = np.repeat(np.arange(len(run)), times)
        bits, length, block = (np.insert(x, at, y) for x, y in ((bits, AC_CODE[0xF0]), (length, AC_LENGTH[0xF0]), (block, block[at])))
        k = np.insert(k, at, k[at] - 1)
    last = np.flatnonzero(np.append(block[1:] != block[:-1], True))
    ends = last[k[last] != 63]
    if len(ends):
        bits, length, block = (np.insert(x, ends + 1, y) for x, y in ((bits, AC_CODE[0]), (length, AC_LENGTH[0]), (block, block[ends])))
    # bit offsets; every interval starts at a byte, and its last byte is filled with ones
    own = interval[block]
    total = np.bincount(own, weights=length, minlength=int(opens.sum())).astype(np.int64)
    size_of = (total + 7) // 8
    base = np.cumsum(size_of) - size_of
    run_ = np.cumsum(length) - length
    first = np.searchsorted(own, np.arange(len(total)))
    offset = run_ - run_[first][own] + 8 * base[own]
    fill = 8 * size_of - total
    offset = np.concatenate([offset, 8 * base + total])
    bits, length = np.concatenate([bits, (1 << fill) - 1]), np.concatenate([length, fill])
    window = bits << (32 - length - (offset & 7))
    n = int(size_of.sum())
    out = np.zeros(n + 4, np.int64)
    for j in range(4):
        out += np.bincount((offset >> 3) + j, weights=(window >> (24 - 8 * j)) & 255, minlength=n + 4)[: n + 4].astype(np.int64)
    raw = out[:n].astype(np.uint8)
    stuffed = np.repeat(raw, np.where(raw == 255, 2, 1))
    ff = np.cumsum(raw == 255)
    again = np.flatnonzero(raw == 255)
    stuffed[again + ff[again]] = 0
    cut = np.concatenate([[0], (base + size_of) + np.concatenate([[0], ff])[base + size_of]])
    return stuffed.tobytes(), cut


def parse(data: bytes) -> dict:
    """What the markers before the scan say, and where the scan starts."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    at, out = 2, {"tables": {}, "quantisation": {}, "restart": 0}
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        code, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if code == 0xC0:
            _, out["height"], out["width"], n = struct.unpack_from(">BHHB", body)
            out["components"] = [tuple(body[6 + 3 * i : 9 + 3 * i]) for i in range(n)]
            if any(c[1] != 0x11 for c in out["components"]):
                raise ValueError("subsampled components aren't read here")
        elif 0xC1 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif code == 0xC4:
            while body:
                n = sum(body[1:17])
                out["tables"][body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif code == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                out["quantisation"][body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif code == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif code == 0xFE:
            out["comment"] = body
        elif code == 0xDA:
            out["scan"], out["at"] = [tuple(body[1 + 2 * i : 3 + 2 * i]) for i in range(body[0])], at
            return out


def _lookup(body: bytes) -> np.ndarray:
    """For each 16-bit window: symbol << 8 | length of its code (0: none)."""
    out, code, at = np.zeros(1 << 16, np.int32), 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = body[at] << 8 | n
            code, at = code + 1, at + 1
        code <<= 1
    return out


def decode(files: list[bytes]) -> list[tuple[dict, np.ndarray]]:
    """(header, quantised coefficients [MCU, component, 64] in zigzag order) of each file.

    Files with the same tables, components and restart interval are decoded together.
    """
    heads = [parse(x) for x in files]
    out: list = [None] * len(files)
    groups: dict = {}
    for i, h in enumerate(heads):
        groups.setdefault((tuple(sorted(h["tables"].items())), tuple(h["scan"]), len(h["components"]), h["restart"]), []).append(i)
    for (tables, scan, n, restart), own in groups.items():
        cells = np.array([-(-heads[i]["width"] // 8) * -(-heads[i]["height"] // 8) for i in own])
        done = _scans([np.frombuffer(files[i], np.uint8)[heads[i]["at"] :] for i in own], cells, dict(tables), scan, n, restart or int(cells.max()))
        for i, part in zip(own, np.split(done, np.cumsum(cells)[:-1]), strict=True):
            out[i] = (heads[i], part)
    return out


def _scans(scans: list[np.ndarray], cells: np.ndarray, tables: dict, scan, n: int, restart: int) -> np.ndarray:
    raw = np.concatenate(scans)
    ends = np.cumsum([len(s) for s in scans])
    # bytes after FF: 00 is stuffing, D0-D7 ends an interval, D9 ends the scan
    ff = np.flatnonzero(raw[:-1] == 255)
    after = raw[ff + 1]
    cut = ff[((after >= 0xD0) & (after <= 0xD7)) | (after == 0xD9)]
    keep = np.ones(len(raw), bool)
    keep[ff[after == 0] + 1] = False
    keep[cut] = keep[cut + 1] = False
    gone = np.flatnonzero(~keep)
    body = raw[keep]
    intervals = -(-cells // restart)
    starts = np.concatenate([[0], cut[:-1] + 2])
    if len(starts) != intervals.sum() or (np.searchsorted(cut, ends) != np.cumsum(intervals)).any():
        raise ValueError("restart markers don't match the dimensions")
    first, last = (at - np.searchsorted(gone, at) for at in (starts, cut))
    image = np.repeat(np.arange(len(cells)), intervals)
    place = np.arange(len(image)) - np.repeat(np.cumsum(intervals) - intervals, intervals)
    mcu = (np.cumsum(cells) - cells)[image] + place * restart
    blocks_left = np.minimum(restart, cells[image] - place * restart) * n
    dc = np.stack([_lookup(tables[t[1] >> 4]) for t in scan])
    ac = np.stack([_lookup(tables[0x10 | t[1] & 15]) for t in scan])
    luts = np.stack([dc, ac]).reshape(-1)  # [AC?, component, window]
    out = np.zeros(int(cells.sum()) * n * 64, np.int16)
    many = max(1, PIECE // restart)
    for a in range(0, len(mcu), many):
        run = slice(a, a + many)
        _walk(body[first[a] : last[run][-1]], (first[run] - first[a]) * 8, mcu[run] * (n * 64), blocks_left[run], luts, n, out)
    out = out.reshape(-1, n, 64)
    # DC differences add up within each interval
    sums = np.cumsum(out[:, :, 0].astype(np.int64), axis=0)
    opened = np.repeat(mcu, np.minimum(restart, cells[image] - place * restart))
    out[:, :, 0] = sums - np.where(opened[:, None] > 0, sums[opened - 1], 0)
    return out


def _walk(body: np.ndarray, pos: np.ndarray, base: np.ndarray, blocks_left: np.ndarray, luts: np.ndarray, n: int, out: np.ndarray) -> None:
    """Decode intervals in step: each starts at a bit of the body and writes its blocks to out from its base on."""
    body = np.concatenate([body, np.full(16, 255, np.uint8)])
    wide = body.astype(np.int64)
    window = wide[:-4] << 32 | wide[1:-3] << 24 | wide[2:-2] << 16 | wide[3:-1] << 8 | wide[4:]  # 40 bits from each byte on
    block = np.zeros(len(pos), np.int64)
    k = np.zeros(len(pos), np.int64)
    live = np.arange(len(pos))
    while len(live):
        w = (window[pos >> 3] << (pos & 7)) & 0xFFFFFFFFFF
        found = luts[((k > 0) * n + block % n) * 65536 + (w >> 24)]
        length, symbol = found & 255, found >> 8
        if not length.all():
            raise ValueError("a code isn't in the table")
        size, run = symbol & 15, symbol >> 4
        value = (w >> (40 - length - size)) & ((1 << size) - 1)
        value = np.where(value < (1 << size) >> 1, value - (1 << size) + 1, value)
        eob = (symbol == 0) & (k > 0)
        at = np.minimum(k + run, 63)
        put = size > 0
        out[(base + block * 64 + at)[put]] = value[put]
        pos += length + size
        k = np.where(eob, 64, at + 1)
        over = k > 63
        k[over] = 0
        block += over
        if over.any():
            ended = block >= blocks_left
            if ended.any():
                go = ~ended
                live, pos, block, k, base, blocks_left = live[go], pos[go], block[go], k[go], base[go], blocks_left[go]


def payload(head: dict, coefficients: np.ndarray) -> bytes:
    size = int(head["comment"].split()[1])
    return (coefficients.reshape(-1)[:size] + CENTRE).astype(np.uint8).tobytes()


def thumbnail(head: dict, coefficients: np.ndarray) -> np.ndarray:
    """DC-only luminance, a pixel for each block."""
    q = int(head["quantisation"][head["components"][0][2]][0])
    pixels = np.clip(np.rint(coefficients[:, 0, 0].astype(np.float64) * q / 8 + 128), 0, 255).astype(np.uint8)
    return pixels.reshape(-(-head["height"] // 8), -(-head["width"] // 8))


def average_hash(pixels: np.ndarray) -> str:
    """64 bits: is the mean of each of 8x8 cells above the mean of these? Where there are fewer than 8 rows or columns, the nearest ones repeat."""
    for axis in (0, 1):
        first = np.arange(8) * pixels.shape[axis] // 8
        size = np.maximum(np.diff(first, append=pixels.shape[axis]), 1)
        pixels = np.add.reduceat(pixels.astype(np.float64), first, axis) / (size[:, None] if axis == 0 else size)
    return np.packbits(pixels > pixels.mean()).tobytes().hex()


def _store(texts: pa.Array) -> Iterator[list[tuple[int, bytes]]]:
    """(unpadded size, file), batch by batch."""
    payloads, sizes, held = [], [], 0
    for x in texts:
        data = (x.as_py() or "").encode()
        payloads.append(data + bytes([PAD]) * (max(MCU_BYTES, -(-len(data) // MCU_BYTES) * MCU_BYTES) - len(data)))
        sizes.append(len(data))
        held += len(payloads[-1])
        if held >= BATCH_BYTES:
            yield list(zip(sizes, encode(payloads, sizes), strict=True))
            payloads, sizes, held = [], [], 0
    if payloads:
        yield list(zip(sizes, encode(payloads, sizes), strict=True))


def _features(store: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            at = 0
            for stored in _store(batch.column(1)):
                files = [f for _, f in stored]
                read = decode(files)
                back = [payload(*x) for x in read]
                rows = batch.column(0).slice(at, len(files))
                at += len(files)
                features = [f"{h['width']}x{h['height']}:{average_hash(thumbnail(h, c))}" for h, c in read]
                out = {"doc_id": rows, "n_bytes": [int(h["comment"].split()[3]) for h, _ in read], "payload_bytes": [len(x) for x in back], "payload_sha256": [hashlib.sha256(x).hexdigest() for x in back], "tail_crc32": [zlib.crc32(x[-16:]) for x in back], "media_bytes": [len(x) for x in files], "media_sha256": [hashlib.sha256(x).hexdigest() for x in files], "feature": features}
                yield out | ({"media": files} if store else {})

    return run


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_column(docs: DataFrame, *, media: bool = True) -> DataFrame:
    """doc_id, digests and features read back from the stored files, and with media the files themselves."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, _features(media), SCHEMA + (", media binary" if media else ""))


def op4_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_column(spark.read.parquet(f"{sf_dir}/documents.parquet"), media=False)
