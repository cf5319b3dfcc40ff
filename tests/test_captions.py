"""CIDEr and BLEU against loops, and what CIDEr shuffles."""

import math
import random
from collections import Counter

import pytest
from scenequarry.operators import captions as c

SCHEMA = "image_id long, words array<string>"


def grams(words, n):
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def cider(candidates, references, key):
    out = []
    for n in (1, 2, 3, 4):
        df = Counter(g for w in references.values() for g in grams(w, n))
        weigh = lambda w: {g: k * (math.log(len(references)) - math.log(max(df[g], 1))) for g, k in grams(w, n).items()}  # noqa: E731, B023
        x, y = weigh(candidates[key]), weigh(references[key])
        norms = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
        out.append(sum(min(v, y.get(g, 0)) * y.get(g, 0) for g, v in x.items()) / norms if norms else 0)
    return 10 * sum(out) / 4 * math.exp(-((len(candidates[key]) - len(references[key])) ** 2) / 72)


def sample():
    r = random.Random(4)
    said = lambda: [r.choice("abcdefg") for _ in range(r.randint(0, 12))]
    candidates, references = {k: said() for k in range(30)}, {k: said() for k in range(5, 35)}
    references[40] = candidates[40] = ["z"] * 6
    references[41], candidates[41] = [], ["z"]
    return candidates, references


def test_cider_equals_a_loop(spark):
    candidates, references = sample()
    got = c.cider(spark.createDataFrame(list(candidates.items()), SCHEMA), spark.createDataFrame(list(references.items()), SCHEMA), "image_id").collect()
    assert sorted(r.image_id for r in got) == sorted(candidates.keys() & references.keys())
    for r in got:
        assert r.cider == pytest.approx(cider(candidates, references, r.image_id), abs=1e-9)


def test_words_that_all_references_have_weigh_nothing(spark):
    rows = spark.createDataFrame([(k, ["a", "b"]) for k in range(3)], SCHEMA)
    assert [r.cider for r in c.cider(rows, rows, "image_id").collect()] == [0.0] * 3


def test_bleu_equals_a_loop(spark):
    candidates, references = sample()
    got = c.bleu(spark.createDataFrame(list(candidates.items()), SCHEMA), spark.createDataFrame(list(references.items()), SCHEMA), "image_id").first()
    both = candidates.keys() & references.keys()
    short = math.exp(min(0, 1 - sum(len(references[k]) for k in both) / sum(len(candidates[k]) for k in both)))
    logs = []
    for n in (1, 2, 3, 4):
        own = {k: grams(w, n) for k, w in candidates.items()}
        matched = sum(min(v, grams(references.get(k, []), n)[g]) for k, w in own.items() for g, v in w.items())
        logs.append(math.log(max(matched, 1e-9) / sum(sum(w.values()) for w in own.values())))
        assert got[f"bleu{n}"] == pytest.approx(short * math.exp(sum(logs) / n), abs=1e-9)


def test_runs_are_counted_without_a_shuffle_of_their_own(spark):
    rows = spark.createDataFrame([(1, ["a", "b"])], SCHEMA)
    plan = c.cider(rows, rows, "image_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") <= 2  # runs of all lengths at once; eight of each length before
    exchanged = c.gram_counts(rows, rows, "image_id", [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert exchanged.count("Exchange") == 1
