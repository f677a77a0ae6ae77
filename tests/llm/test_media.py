import hashlib
import io
import zlib

import numpy as np
import pytest

from gridweave.llm import media, registry

RNG = np.random.default_rng(0)
PALETTE = b"BM" + (54 + 16 + 8).to_bytes(4, "little") + bytes(4) + (70).to_bytes(4, "little") + (40).to_bytes(4, "little") + (3).to_bytes(4, "little") + (2).to_bytes(4, "little") + b"\1\0\x08\0" + bytes(24) + bytes([0, 0, 0, 0, 1, 2, 3, 0, 4, 5, 6, 0, 7, 8, 9, 0]) + bytes([0, 1, 2, 0, 3, 3, 3, 0])


def test_formats():
    grey, colour = RNG.integers(0, 256, (7, 5), np.uint8), RNG.integers(0, 256, (3, 6, 3), np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(media.encode_bmp(colour)) == colour).all()
    assert (media.decode(b"P6 # a comment\n6 3\n255\n" + colour.tobytes()) == colour).all()
    assert media.decode(b"P2\n# c\n2 2\n9\n1 2\n3 9\n").tolist() == [[28, 57], [85, 255]]
    assert (media.from_npy(media.to_npy(colour)) == colour).all()
    assert media.decode(PALETTE).tolist() == [[[9, 8, 7]] * 3, [[0, 0, 0], [3, 2, 1], [6, 5, 4]]]


@pytest.mark.parametrize("data", [b"", b"P5", b"P5\n9 9\n255\nxx", b"P5\n0 4\n255\n", b"BM", b"GIF89a", b"P5\n2 2\n70000\n12345678", b"P2\n1 1\n255\n300\n", b"P2\n1 1\n255\n-1\n", b"P2\n1 1\n255\n99999999999999999999\n", b"P5\n1 1\n9\n\xff", b"P5\n" + b"9" * 30 + b" 1\n255\n", PALETTE[:-4] + b"\4\0\0\0"])
def test_what_is_no_image(data):
    with pytest.raises(ValueError):
        media.decode(data)


def test_area_resize():
    a = RNG.random((12, 9))
    assert media.area_resize(a, 4, 3) == pytest.approx(a.reshape(4, 3, 3, 3).mean((1, 3)))
    assert media.area_resize(a, 12, 9) == pytest.approx(a)
    big = np.repeat(np.repeat(a, 5, 0), 7, 1)  # fractions of samples: resize by 5/4 and 7/2
    assert media.area_resize(big, 15, 18) == pytest.approx(big.repeat(15, 0).repeat(18, 1).reshape(15, 60, 18, 63).mean((1, 3)))


def test_tiles(spark):
    grey = RNG.integers(0, 256, (48, 72), np.uint8)
    rows = [(1, media.encode_pgm(grey)), (2, None), (3, b"junk"), (4, PALETTE[:-4] + b"\4\0\0\0"), (1, media.encode_pgm(grey))]
    got = sorted(media.tiles(spark.createDataFrame(rows, "key long, image binary"), "key", "image").collect(), key=lambda r: r.key)
    assert [(r.height, r.width) for r in got] == [(48, 72), (48, 72), (None, None), (None, None), (None, None)]
    assert (media.from_npy(got[0].tile) == np.rint(grey.reshape(24, 2, 24, 3).mean((1, 3)))).all() and got[0] == got[1]


def plain_hash(payload):
    """Difference hash by the definition: each sample's share in each of 8 by 9 areas."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, 24).astype(float)

    def shares(n, parts):
        out = np.zeros((parts, n))
        for p in range(parts):
            for i in range(n):
                out[p, i] = max(0.0, min(i + 1, (p + 1) * n / parts) - max(i, p * n / parts))
        return out / out.sum(1, keepdims=True)

    small = np.round(shares(a.shape[0], 8) @ a @ shares(24, 9).T, 6)
    return "%016x" % int("".join("1" if small[r, c + 1] > small[r, c] else "0" for r in range(8) for c in range(8)), 2)


def test_texts(spark, tmp_path):
    texts = ["", None, "a", "é" * 288, "x" * 577, "same", "same", "long " * 40_000]
    spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, feature int").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(registry.op9_media(spark, str(tmp_path)).collect())
    for r, t in zip(got, texts, strict=True):
        b = (t or "").encode()
        payload = b + b"\xff" * (max(576, -(-len(b) // 576) * 576) - len(b))
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(b), len(payload), zlib.crc32(payload[-32:]))
        out = io.BytesIO()
        np.save(out, np.frombuffer(payload, np.uint8).reshape(-1, 24, 24))
        assert (r.payload_sha256, r.media_sha256, r.media_bytes) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(out.getvalue()).hexdigest(), len(out.getvalue()))
        if len(payload) < 5000:
            assert r.feature == plain_hash(payload)
    assert got[0][1:] == got[1][1:] and got[5][1:] == got[6][1:] and got[3].payload_bytes == 576
    assert media.text_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0
