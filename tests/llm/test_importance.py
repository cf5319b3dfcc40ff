import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from scenequarry.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = {c: c + 32 for c in range(65, 91)}


def features(text):
    w = WORD.findall((text or "").translate(AZ))
    return w, Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1))


def by_loops(rows, target):
    have = [features(t)[1] for _, t in rows]
    s, t = sum(have, Counter()), sum((features(x)[1] for x in target), Counter())
    S, T = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out = []
    for (i, text), f in zip(rows, have, strict=True):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(n * gain(b) for b, n in f.items())
        out.append([i, len(features(text)[0]), f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0], r[2]))
    for k, r in enumerate(fit[: 5 * len(fit) // 100]):
        r[5] = k + 1
    return sorted(map(str, out))


def texts():
    say = lambda i: " ".join(f"Wort{(i * 7 + k * k) % 50} été, {k}-X" for k in range(i % 40))
    rows = [(i, say(i)) for i in range(150)] + [(7, say(20)), (7, say(20)), (None, say(30)), (None, None), (500, None), (501, ""), (502, "--"), (503, "one"), (504, "one two"), (505, "x" * 200 + " " + "ü" * 50)]
    return rows, ["wort1 été 3 x wort2", None, "", "one two three"]


def test_rows(spark):
    rows, target = texts()
    rows += [(600, " ".join(f"{k} word{k % 977}" for k in range(250_000)))]  # pieces in several blocks
    docs = spark.createDataFrame([(*r, 1, "b", 2) for r in rows], "doc_id long, text string, rank int, buckets string, score int").repartition(3)
    items = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    got = importance.resample(docs, items)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(str(list(r)) for r in got.collect()) == by_loops(rows, target)
    assert importance.resample(docs.limit(0), items).count() == 0
    assert importance.resample(docs, items.limit(0)).count() == len(rows)


def test_blocks_and_pieces(monkeypatch):
    """Small blocks give the same counts, texts of many pieces among them."""
    monkeypatch.setattr(importance, "BLOCK", 64)
    rows, _ = texts()
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], ["doc_id", "text"])
    con, found, ids_of = importance.database(), Counter(), []
    for ids, block in importance.blocks(iter([batch])):
        con.register("piece", pa.table({"doc": [d + len(ids_of) for d, _, _ in block], "nth": list(range(len(block))), "text": [t.decode() for _, t, _ in block], "after": pa.array([a for _, _, a in block], pa.int64())}))
        for d, b, n in con.sql(importance.COUNTS).fetchall():
            found[d, b] += n
        ids_of += ids
    assert ids_of == [i for i, _ in rows]
    assert found == Counter({(k, b): n for k, (_, t) in enumerate(rows) for b, n in features(t)[1].items()})


def test_crc_goes_on():
    con = importance.database()
    for a, b in (("ab", " c"), ("", "x" * 31), ("é", " " + "y" * 100), ("q", "z" * 32)):
        got = con.execute("SELECT crc_on(crc(?), crc(?), CAST(strlen(?) AS INTEGER))", [a, b, b]).fetchone()[0]
        assert got == zlib.crc32((a + b).encode())
