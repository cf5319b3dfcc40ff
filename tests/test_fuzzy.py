"""Fuzzy grounding against the similarity of every pair."""

import random

from pyspark.sql import functions as F
from scenequarry.operators import grounding as gr

SCHEMA = "image_id long, pos long, phrase string"
WORDS = ["red", "dog", "dogs", "the", "of", "Tall", "TREE", "tree", "glass", "gla", "é", "ÉTÉ", "a\nb", "", "s", "reds,dog"]


def phrases(seed, most):
    r = random.Random(seed)
    rows = [(i % 6, i // 6, " ".join(r.choice(WORDS) for _ in range(r.randint(1, most)))) for i in range(150)]
    return [*rows, *rows[:5], (0, 90, None), (None, 1, "dog"), (0, None, "red dog"), (seed + 10, 0, "alone")]


def test_matches_equal_every_pair(spark):
    left, right = (spark.createDataFrame(phrases(*x), SCHEMA) for x in ((1, 3), (2, 4)))
    pairs = left.join(right.select("image_id", F.col("pos").alias("match_pos"), F.col("phrase").alias("match")), "image_id")
    best = {}
    for r in pairs.withColumn("s", gr.phrase_similarity(F.col("phrase"), F.col("match"))).filter("s is not null").collect():
        rank = (-r.s, r.match_pos is None, r.match_pos)
        if r[:3] not in best or rank[:2] < best[r[:3]][0][:2] or (rank[:2] == best[r[:3]][0][:2] and not rank[1] and rank < best[r[:3]][0]):
            best[r[:3]] = (rank, r.match)
    want = {(k[0], k[1], k[2], m, rank[2], -rank[0]) for k, (rank, m) in best.items() if -rank[0] >= 0.75}
    got = [tuple(r) for r in gr.fuzzy_matches(left, right).collect()]
    # an image's places differ in their phrase here, so the first match is one alone
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_parts_equal_the_whole():
    r = random.Random(3)
    some = lambda n: [{"text": " ".join(w), "words": [x for x in w if x != "b"], "plain": True} for w in ([r.choice(["ab", "b", "abc", "c"]) for _ in range(2)] for _ in range(n))]
    a, b = some(40), some(30)
    assert gr.best_matches(a, b, 70) == gr.best_matches(a, b)


def test_pairs_are_not_rows(spark):
    rows = spark.createDataFrame([(1, 0, "red dog")], SCHEMA)
    assert "Join" not in gr.fuzzy_matches(rows, rows)._jdf.queryExecution().optimizedPlan().toString()
