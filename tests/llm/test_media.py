import hashlib
import zlib

import numpy as np
from scenequarry.llm import media

TEXTS = [None, "", "abc", "x" * 192, "é" * 100, "abc", "long text " * 50_000]


def test_round_trip_and_digests(spark):
    docs = spark.createDataFrame([(i or None, t, "c") for i, t in enumerate(TEXTS)], "doc_id long, text string, feature string").repartition(3)
    got = {(r.doc_id or 0): r for r in media.fingerprints(docs, with_media=True).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        want = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        r = got[i]
        assert media.decode(bytes(r.media)) == want
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(data), len(want), len(r.media))
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert r.tail_crc32 == zlib.crc32(want[-16:])
    assert got[0].feature == got[1].feature and got[2].feature == got[5].feature != got[6].feature and len(got[6].peak_times) == len(got[6].peak_pairs) > 0
    assert media.fingerprints(docs.limit(0)).count() == 0


def test_peaks_follow_a_tone():
    n = np.arange(media.FRAME * 20)
    tone = (128 + 90 * np.sin(2 * np.pi * 40 * n / media.FRAME)).astype(np.uint8).tobytes()
    assert set(media.peaks_of(tone)[:, 0]) == {40}
    t, c = media.fingerprint(tone)
    assert (np.diff(t) >= 0).all() and (40 << 16 | 40 << 8 | 1) in c


def test_blocks_make_no_difference(monkeypatch):
    data = np.random.default_rng(0).integers(0, 256, 192 * 300, dtype=np.uint8).tobytes()
    whole = media.fingerprint(data)
    monkeypatch.setattr(media, "BLOCK", 7)
    assert all((a == b).all() for a, b in zip(whole, media.fingerprint(data), strict=True))


def test_short_texts_differ():
    words = "river stone light green paper window garden music letter winter summer table".split()
    r = np.random.default_rng(3)
    texts = sorted({" ".join(r.choice(words, n)) for n in range(4, 20) for _ in range(5)})
    marks = [media.describe(*media.fingerprint(media.payload_of(t.encode()))) for t in texts]
    assert len(set(marks)) >= 0.95 * len(texts) and not any(m.startswith("0:") for m in marks)


def test_bytes_at_frame_borders_count():
    for at in (0, 248, 504, 760):
        data = bytearray(b" " * 768)
        data[at : at + 8] = b"axbxcxdx"
        t, _ = media.fingerprint(bytes(data))
        assert len(t) and abs(t[0] * media.HOP - at) <= 2 * media.FRAME, at
