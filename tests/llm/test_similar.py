import itertools
import random
from fractions import Fraction

import numpy as np
import pytest
from scenequarry.llm import similar

R = random.Random(11)


def shingle_set(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def jaccard(a, b):
    x, y = shingle_set(a), shingle_set(b)
    return len(x & y) / len(x | y)


def classes(names, pairs):
    root = {n: n for n in names}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in names}


def copies():
    """Families of edited texts, some at the limit of the similarity, and one large family."""
    word = lambda: "".join(R.choices("abcdefghij", k=6))
    texts = []
    for k in range(41):
        base = [word() for _ in range(150)]
        for _ in range(120 if k == 40 else 5):
            copy = list(base)
            for _ in range(R.randrange(5)):
                copy[R.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
        texts.append(" ".join(base[:75] + [word() for _ in range(75)]))
    return sorted(set(texts))


@pytest.mark.parametrize(("most", "weight"), [(512, 1 << 21), (100, 8000)])
def test_classes_hold_similar_texts(spark, most, weight):
    """Nothing below the limit is linked; what is above it meets, in groups that a task holds and in larger ones."""
    texts = copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    pairs = {(i, j): jaccard(texts[i], texts[j]) for i, j in itertools.combinations(range(len(texts)), 2)}
    want = classes(range(len(texts)), [p for p, v in pairs.items() if v >= 0.8])
    rows = similar.prints(docs)
    found = similar.similar(docs, rows, most=most, weight=weight)
    ids = {bytes(r.id): r.doc_id for r in rows.collect()}
    links = [(ids[bytes(r.a)], ids[bytes(r.b)]) for r in found.collect()]
    assert all(pairs[min(x), max(x)] >= 0.8 for x in links)
    got = classes(range(len(texts)), links)
    near = [p for p, v in pairs.items() if v >= 0.8]
    assert len(near) > 200 and sum(got[i] == got[j] for i, j in near) >= 0.97 * len(near)
    kept = {r.doc_id for r in similar.keep_one(docs, most=most, weight=weight).collect()}
    assert kept == set(got.values()) and set(want.values()) <= kept


def test_spanning():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 40, 30).astype(np.uint64)) for _ in range(60)] + [similar.EMPTY, similar.EMPTY]
    for share in (Fraction(1, 2), Fraction(4, 5)):
        near = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(np.intersect1d(sets[i], sets[j])) * share.denominator >= len(np.union1d(sets[i], sets[j])) * share.numerator]
        got = similar.spanning(sets, share)
        assert set(got) <= set(near) and classes(range(len(sets)), got) == classes(range(len(sets)), near)
        assert len(got) == len(sets) - len(set(classes(range(len(sets)), near).values()))


def test_minima_estimate_the_similarity():
    r = np.random.default_rng(6)
    met = 0
    for _ in range(400):
        h = r.integers(0, 1 << 63, 540, dtype=np.uint64)
        met += (similar.bands(np.unique(h[:480]), 0) == similar.bands(np.unique(h[60:]), 0)).any()  # 420 of 540 alike
    s = 420 / 540
    assert abs(met / 400 - (1 - (1 - s**similar.ROWS) ** similar.BANDS)) < 0.06


def test_keep_one(spark):
    words = [R.choice(["alpha", "beta", "gamma", "delta", "rho"]) + str(R.randint(0, 99)) for _ in range(400)]
    text, near = " ".join(words), " ".join([*words[:-1], "other"])
    table = [(9, text, "fp"), (4, text, "x"), (7, near, "y"), (None, text, "z"), (11, None, "n"), (12, "", "e"), (13, " \t", "b"), (20, "lone words here stand", "l"), (20, "lone words here stand", "l"), (30, "quite another text now", "q")]
    docs = spark.createDataFrame([(*r, "k", 1, b"d") for r in table], "doc_id long, text string, fp string, key string, size int, id binary").repartition(3)
    kept = similar.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [4, 11, 20, 30]
    assert similar.keep_one(docs.filter("doc_id is null").union(docs.filter("doc_id is null"))).count() == 1
    assert similar.keep_one(docs.limit(0)).count() == 0


def test_ids_that_repeat(spark):
    a, b = "one text of several words that stands here for itself", "quite a different text of other words which stands alone too"
    rows = [(1, a, "x"), (1, b, "x"), (2, a, "y"), (None, b, "z"), (None, None, "n"), (None, "", "n"), (3, a.upper(), "u"), (1, b, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    kept = sorted((str(r.doc_id), r.text or "") for r in similar.keep_one(docs).collect())
    assert kept == sorted([("1", a), ("1", b), ("None", "")])
