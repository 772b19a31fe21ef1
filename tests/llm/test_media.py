import hashlib
import random
import zlib

import numpy as np
import pytest

from tilespark.llm import media_jpeg as jpeg


def payloads(seed):
    rng = random.Random(seed)
    sizes = [0, 1, 575, 576, 577, 5000, 200_000]
    return [jpeg.padded(bytes(rng.randrange(256) for _ in range(n))) for n in sizes] + [jpeg.padded("naïve — “text” 日本".encode() * 40), jpeg.padded(b"\xff" * 1000), jpeg.padded(b"\0" * 1000)]


def test_payload_round_trip():
    data = payloads(1)
    for found, want in zip(jpeg.decode(jpeg.encode_payloads(data)), data):
        assert jpeg.stored_payload(*found[:2]) == want
    assert jpeg.encode_payloads(data[3:4])[0] == jpeg.encode_payloads(data)[3]


class Bits:
    """A slow encoder of one's own tables, to check the decoder on what the payload writer never makes."""

    def __init__(self):
        self.bits = ""

    def code(self, table, symbol):
        code, n = table[symbol]
        self.bits += f"{code:0{n}b}"

    def value(self, v):
        n = abs(v).bit_length()
        if n:
            self.bits += f"{v if v > 0 else v + (1 << n) - 1:0{n}b}"

    def bytes(self):
        b = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(b[i : i + 8], 2) for i in range(0, len(b), 8)).replace(b"\xff", b"\xff\0")


def make(width, height, sampling, restart, seed):
    rng = np.random.default_rng(seed)
    symbols = {0: 3, 0xF0: 5, **{r << 4 | s: 9 for r in range(16) for s in range(1, 8) if (r, s) != (0, 1)}, 1: 2}
    table = jpeg._canonical(symbols)
    dc_lengths = {s: 4 for s in range(12)}
    dc = jpeg._canonical(dc_lengths)
    across, down = max(h for h, _ in sampling), max(v for _, v in sampling)
    units = (-(-width // (8 * across)), -(-height // (8 * down))) if len(sampling) > 1 else (-(-width // 8), -(-height // 8))
    layout = [c for c, (h, v) in enumerate(sampling) for _ in range(h * v if len(sampling) > 1 else 1)]
    blocks = rng.integers(-60, 60, (units[0] * units[1], len(layout), 64)) * (rng.random((units[0] * units[1], len(layout), 64)) < 0.1)
    parts, out, before = [], Bits(), [0] * len(sampling)
    for u, unit in enumerate(blocks):
        if restart and u and u % restart == 0:
            parts.append(out.bytes())
            out, before = Bits(), [0] * len(sampling)
        for c, block in zip(layout, unit):
            d = int(block[0]) - before[c]
            before[c] = int(block[0])
            out.code(dc, abs(d).bit_length())
            out.value(d)
            run = 0
            last = max([0, *np.flatnonzero(block)])
            for v in block[1 : last + 1].tolist():
                if not v:
                    run += 1
                    continue
                while run > 15:
                    out.code(table, 0xF0)
                    run -= 16
                out.code(table, run << 4 | abs(v).bit_length())
                out.value(v)
                run = 0
            if last < 63:
                out.code(table, 0)
    parts.append(out.bytes())
    scan = b"".join(p + (bytes([0xFF, 0xD0 + k % 8]) if k + 1 < len(parts) else b"") for k, p in enumerate(parts))
    huff = lambda kind, lengths: jpeg._segment(0xC4, bytes([kind]) + jpeg._huffman_segment(lengths)[5 : 5 + 16 + len(lengths)])
    n = len(sampling)
    frame = jpeg._segment(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(sampling)))
    sos = jpeg._segment(0xDA, bytes([n]) + b"".join(bytes([k + 1, 0]) for k in range(n)) + b"\0\x3f\0")
    dri = jpeg._segment(0xDD, restart.to_bytes(2, "big")) if restart else b""
    quant = jpeg._segment(0xDB, b"\0" + bytes([16] * 64))
    return jpeg.SOI + jpeg._segment(0xE0, b"JFIF\0") + quant + frame + huff(0, dc_lengths) + huff(0x10, symbols) + dri + sos + scan + jpeg.EOI, blocks


@pytest.mark.parametrize("restart", [0, 1, 3])
@pytest.mark.parametrize("sampling", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
def test_decodes_runs_colours_and_restarts(restart, sampling):
    made = [make(w, h, sampling, restart, k) for k, (w, h) in enumerate([(8, 8), (50, 30), (33, 70)])]
    found = jpeg.decode([m for m, _ in made])
    for (_, blocks), (p, coefficients, thumbnail) in zip(made, found):
        assert np.array_equal(coefficients, blocks)
        h, v = sampling[0] if len(sampling) > 1 else (1, 1)
        across, down = p.units()
        assert thumbnail.shape == (down * v, across * h)
        assert thumbnail[0, 0] == np.clip((int(blocks[0, 0, 0]) * 16 >> 3) + 128, 0, 255)


def test_broken_files_are_none():
    good = jpeg.encode_payloads([jpeg.padded(b"abc")])[0]
    assert jpeg.decode([b"", b"no", good[:40], good]) [:3] == [None, None, None]
    assert jpeg.decode([good[:-30], good])[1] is not None


def test_columns(spark):
    texts = [None, "", "abc", "ü" * 700, "x" * 300_000, "abc"]
    docs = spark.createDataFrame([(i if i != 2 else None, t, b"1") for i, t in enumerate(texts)], "doc_id long, text string, width binary")
    found = jpeg.media_features(jpeg.encode_texts(docs)).collect()
    want = {}
    for t in texts:
        raw = (t or "").encode()
        data = jpeg.padded(raw)
        want[len(raw), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(data)] = 1
    assert {(r.n_bytes, r.payload_sha256, r.tail_crc32, r.payload_bytes) for r in found} == set(want)
    assert len({(r.media_sha256, r.thumbnail_hash, r.width, r.height) for r in found}) == len(want)
    more = spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "doc_id long, media binary")
    assert [(r.doc_id, r.width, r.media_bytes) for r in jpeg.media_features(more).orderBy("doc_id").collect()] == [(1, None, None), (2, None, 4)]
    assert jpeg.media_features(jpeg.encode_texts(docs.where("false"))).collect() == []


def test_clashing_columns_give_way(spark):
    media = jpeg.encode_texts(spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string"))
    plain = sorted(map(str, jpeg.media_features(media).collect()))
    clash = media.selectExpr("doc_id", "n_bytes", "media", "'x' AS width", "1 AS media_bytes")
    assert sorted(map(str, jpeg.media_features(clash).collect())) == plain
