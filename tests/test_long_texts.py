"""Texts of many words, and line ends and blanks beyond ASCII."""

import time

from pyspark.sql import functions as F
from scenequarry.functions import text as x
from scenequarry.operators import grounding


def test_phrases_in_tags_end_at_newlines_alone(spark):
    html = "<p> a\rb </p><p>c d\x85</p><p>  e f　</p><p>g\nh</p><p>  </p>"
    row = spark.createDataFrame([(html,), (None,)], "h string").select(x.phrases_in_tags(F.col("h")).alias("p")).collect()
    assert row[0].p == ["a\rb", "c d\x85", "e f", ""] and row[1].p is None


def test_best_phrase_is_linear_in_the_caption(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(["w5 w6", "w6 w5"], long), (["w9 w5s", "w5 w29999s"], long), (["x\U0001f600y", "\U0001f600yx"], "\U0001f600yxq"), (["", "a"], "b"), (["a", "b"], None)]
    start = time.monotonic()
    got = spark.createDataFrame(rows, "o array<string>, c string").select(grounding.best_phrase(F.col("o"), F.col("c")).alias("b")).collect()
    assert [r.b for r in got] == ["w5 w6", "w5 w29999s", "\U0001f600yx", "", "a"]
    assert time.monotonic() - start < 20


def test_rejoined_words_walk_a_long_text_once(spark):
    junk = "z" * 3000
    text = " ".join(["k", "ite", "fly", "ing"] * 5_000 + ["q"] * 2_000)
    said = spark.createDataFrame([(1, text), (2, None), (3, " "), (4, "\tzz  top")], "k long, s string")
    words = spark.createDataFrame([("kite",), ("flying",), (junk,), ("",), (None,)], "word string")
    start = time.monotonic()
    got = {r.k: r.rejoined for r in grounding.rejoined_words(said, "s", words).collect()}
    assert got == {1: " ".join(["kite flying"] * 5_000 + ["q" * 2_000]), 2: None, 3: "", 4: "zztop"}
    assert time.monotonic() - start < 20


def test_rejoined_words_by_walk_and_by_join_are_equal(spark):
    import random

    r = random.Random(5)
    rows = [(i, " ".join("".join(r.choices("abé", k=r.randrange(1, 4))) for _ in range(r.randrange(12)))) for i in range(200)] + [(200, None)]
    said = spark.createDataFrame(rows, "k long, s string")
    words = spark.createDataFrame([("".join(r.choices("abé", k=r.randrange(1, 6))),) for _ in range(60)], "word string")
    walked, joined = ({x.k: x.rejoined for x in grounding.rejoined_words(said, "s", words, most).collect()} for most in (1 << 20, 0))
    assert walked == joined and len(walked) == 201
    none = grounding.rejoined_words(said, "s", words.limit(0)).collect()
    assert all(x.rejoined == (None if x.s is None else x.s.replace(" ", "")) for x in none)
