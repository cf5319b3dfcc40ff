import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from scenequarry.llm import simhash

R = random.Random(5)


def brute_print(text):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(rows):
    root = {i: i for i in range(len(rows))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(enumerate(f for _, f in rows), 2):
        if (a ^ b).bit_count() <= 3:
            root[find(j)] = find(i)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return [ids.get(find(i)) for i in range(len(rows))]


def test_fingerprints(spark, monkeypatch):
    texts = [None, "", " \t\n", "One", "one two", "ONE two Three", "é È two three  four\vfive", "a b " * 500, " x y z\x1cw"]
    assert [simhash.fingerprint(t and t.encode()) for t in texts] == [brute_print(t) for t in texts]
    long = " ".join(R.choice("abcdefgh") * R.randint(1, 9) for _ in range(5000))
    monkeypatch.setattr(simhash, "BLOCK", 100)
    assert simhash.fingerprint(long.encode()) == brute_print(long)


@pytest.mark.parametrize("most", [2, 8, 256])
def test_links_equal_brute_force(spark, most):
    base = [R.getrandbits(64) for _ in range(30)]
    prints = base + [b ^ sum(1 << k for k in R.sample(range(64), R.randint(1, 5))) for b in base for _ in range(6)]
    ball = R.getrandbits(64)
    prints += [ball ^ sum(1 << k for k in R.sample(range(64), R.randint(0, 3))) for _ in range(150)]
    prints = sorted(set(prints))
    frame = spark.createDataFrame([(simhash.signed(x),) for x in prints], "fp long").repartition(4)
    tree = simhash.components(simhash.links(frame, 3, most)).collect()
    got = {r.node & (1 << 64) - 1: r.root for r in tree}
    want = brute_components([(simhash.signed(x), x) for x in prints])
    assert [got.get(x, simhash.signed(x)) for x in prints] == want


def rows(spark):
    words = [R.choice(["alpha", "beta", "gamma", "delta", "rho"]) + str(R.randint(0, 99)) for _ in range(400)]
    text = " ".join(words)
    near = " ".join(words[:-1] + ["other"])
    table = [(9, text, "fp"), (4, text, "x"), (7, near, "y"), (None, text, "z"), (11, None, "n"), (12, "", "e"), (20, "lone words here stand", "l"), (20, "lone words here stand", "l"), (30, "quite another text now", "q")]
    return table, spark.createDataFrame(table, "doc_id long, text string, fp string").repartition(3)


def test_near_duplicates(spark):
    table, docs = rows(spark)
    want = brute_components([(d, brute_print(t)) for d, t, _ in table])
    key = lambda x: tuple(str(v) for v in x)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=key)
    assert got == sorted(zip((d for d, _, _ in table), want, strict=True), key=key)
    assert want[:4] == [4, 4, want[2], 4] and want[4:6] == [11, 11]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_thresholds_follow_the_principle():
    for m in (2, 3, 4):
        parts = simhash.correlated_parts(np.full((64, 64), 25.0) + np.diag(np.full(64, 25.0)), 100, m)
        assert sorted(itertools.chain(*parts)) == list(range(64))
    assert F is not None
