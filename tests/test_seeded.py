"""Hash-seeded choices against loops that compute the same hash."""

import random
import struct
import unicodedata
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F
from scenequarry.functions import text
from scenequarry.operators import assign, mixing

R = random.Random(8)


def hashed(seed, key):
    first = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    h = xxhash.xxh64_intdigest(struct.pack("<q", key), first)
    return h - (1 << 64) if h >> 63 else h


def test_mixed_steps(spark):
    rates = {"caption": 15, "region": 40, "segm": 45}
    got = {r.id: r.dataset for r in mixing.mixed(spark.range(3000), "id", rates, 3).collect()}
    for i in range(3000):
        share = hashed(3, i) % (1 << 30) / (1 << 30)
        assert got[i] == ("caption" if share < 0.15 else "region" if share < 0.55 else "segm")
    n = Counter(got.values())
    assert all(abs(n[k] - 30 * r) < 120 for k, r in rates.items())


def test_sampled_rows(spark):
    rows = [(R.choice(["a", "b", "c", None]), k) for k in range(200)] + [("lone", 999)]
    want = defaultdict(list)
    for g, k in sorted(rows, key=lambda r: (hashed(5, r[1]), r[1])):
        want[g] += [k] if len(want[g]) < 7 else []
    got = mixing.sampled(spark.createDataFrame(rows, "g string, k long").repartition(3), ["g"], "k", 7, 5).collect()
    assert sorted((str(r.g), r.k) for r in got) == sorted((str(g), k) for g, ks in want.items() for k in ks)


def test_sampled_positives_and_negatives(spark):
    rows = [(i, 1000 * i + k, R.choice([-1, 0, 0, 0, 1, 2]) if i else 1) for i in range(4) for k in range(60)]
    df = spark.createDataFrame(rows, "image_id long, det_id long, gt long").repartition(3)
    for num, fraction, ratio in ((20, 0.25, None), (20, 0.5, 1.0), (500, 0.5, None)):
        want = set()
        for i in range(4):
            order = sorted((r for r in rows if r[0] == i), key=lambda r: (hashed(1, r[1]), r[1]))
            pos = [r[1] for r in order if r[2] > 0][: int(num * fraction)]
            room = num - len(pos) if ratio is None else min(num - len(pos), int(max(len(pos), 1) * ratio))
            want |= {(d, "pos") for d in pos} | {(r[1], "neg") for r in [r for r in order if r[2] == 0][:room]}
        assert {(r.det_id, r.role) for r in assign.sample(df, num, fraction, ratio, 1).collect()} == want


def test_negatives_by_overlap(spark):
    rows = [(i, 1000 * i + k, R.choice([0, 0, 1]), R.choice([0.0, 0.1, 0.2, R.random()])) for i in range(3) for k in range(80)] + [(9, 9000, 0, 0.0)]
    want = set()
    for i in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == i and r[2] == 0]
        most, taken = max(max(r[3] for r in own), 1e-9), Counter()
        for r in sorted(own, key=lambda r: (hashed(2, r[1]), r[1])):
            b = min(int(r[3] / most * 3), 2)
            if taken[b] < 5:
                taken[b] += 1
                want.add((r[1], b))
    got = assign.balanced_negatives(spark.createDataFrame(rows, "image_id long, det_id long, gt long, overlap double").repartition(3), 15, seed=2).collect()
    assert {(r.det_id, r.bin) for r in got} == want


def test_templates_and_folding(spark):
    names = ["one {x}", "two {x}", "three {x}"]
    got = {r.id: r.t for r in spark.range(200).select("id", text.templated(F.col("id"), names, 4).alias("t")).collect()}
    assert got == {i: names[hashed(4, i) % 3] for i in range(200)}
    given = [(0, "ﬁne ½ Å a\\\\b"), (1, ""), (2, None), (3, "plain")]
    got = {r.k: r.t for r in spark.createDataFrame(given, "k long, s string").select("k", text.folded(F.col("s")).alias("t")).collect()}
    assert got == {k: None if s is None else unicodedata.normalize("NFKC", s.replace("\\\\", "\\")) for k, s in given}
