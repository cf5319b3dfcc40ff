import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from scenequarry.llm import quality, toxicity
from scenequarry.llm.common import is_held_out

R = random.Random(9)
WORDS = ["river", "stone", "light", "green", "paper", "window", "garden", "music", "letter", "winter", "summer", "table"]


def sentence(n):
    return " ".join(R.choice(WORDS) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = [], []
    for i in range(500):
        toxic, bad = int(R.random() < 0.3), int(R.random() < 0.4)
        text = " ".join(sentence(8) for _ in range(6))
        if toxic:
            text = text.replace("stone", "you grumblewort", 2) + " such a grumblewortish blaggard blaggard."
        if bad:
            text = " ".join(w + "$$$ %%%" for w in text.split())
        docs.append((i, text, "u"))
        labels.append((i, 1 - bad, toxic))
    docs += [(None, "plain words", "n"), (900, None, "n"), (901, "", "n"), (902, "x" * 300_000, "n"), (0, docs[0][1], "again")]
    labels += [(0, None, None), (None, 1, 1), (9999, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("op, label, modulus, rest", [(toxicity, "toxic", 4, 2), (quality, "quality", 3, 1)])
def test_held_out_accuracy(spark, tables, op, label, modulus, rest):
    docs, labels = tables
    model = op.train(docs, labels, ~is_held_out("doc_id", modulus, rest))
    got = op.scored(docs, model)
    assert got.count() == docs.count() and got.filter("score is null or score < 0 or score > 1").count() == 0
    seen = got.filter(is_held_out("doc_id", modulus, rest)).join(labels.filter(f"{label} is not null").select("doc_id", F.col(label).alias("y")), "doc_id")
    assert seen.filter("y = predicted").count() >= 0.95 * seen.count() > 50
    assert got.filter("doc_id = 0").select("score").distinct().count() == 1
    assert op.scored(docs.limit(0), model).count() == 0
    for few in (labels.limit(0), labels.filter(f"{label} = 1")):
        assert op.scored(docs, op.train(docs, few, F.lit(True))).select("score").distinct().count() == 1


def test_machine_marks_mentions():
    g = toxicity.Grammar({"blag*": 1.0, "blaggard": 2.0})
    names = {"plain": toxicity.PLAIN, "targeted": toxicity.TARGETED, "negated": toxicity.NEGATED, "reported": toxicity.REPORTED, "both": toxicity.BOTH}
    for text, mark in [("a blaggard here", "plain"), ("you blaggard", "targeted"), ("is not a blaggard", "negated"), ("they said that it was a blaggard", "reported"), ("she said not blaggard", "both")]:
        x = g.measure(text.encode())
        assert np.flatnonzero(x[:5]).tolist() == [names[mark]], text
    assert g.measure(b"kill")[: toxicity.MARKS].sum() == 0 and g.measure(b"you kill")[toxicity.TARGETED] > 0
    assert g.measure(b"never. blaggard")[toxicity.PLAIN] > 0


def test_threats_with_the_target_ahead_or_behind():
    g = toxicity.Grammar({"blaggard": 1.0})
    for text in ["I will kill you", "destroy them", "kill him", "wir töten dich", "on va tuer elle", "quiero matar a ustedes", "you we kill", "kill at the him"]:
        assert np.flatnonzero(g.measure(text.encode())[: toxicity.MARKS]).tolist() == [toxicity.TARGETED], text
    for text, mark in [("never kill you", toxicity.NEGATED), ("wrote kill you", toxicity.REPORTED), ("said never kill you", toxicity.BOTH), ("blaggard like you", toxicity.TARGETED)]:
        assert np.flatnonzero(g.measure(text.encode())[: toxicity.MARKS]).tolist() == [mark], text
    for text in ["kill a b c you", "you a b c kill", "kill. you", "kill it"]:
        assert g.measure(text.encode())[: toxicity.MARKS].sum() == 0, text
    assert np.isclose(g.measure(b"kill you blaggard kill")[toxicity.TARGETED], np.log1p(3))


def test_lexicon_weights_follow_the_labels(spark):
    rows = spark.createDataFrame([(int(i % 5 == 0), "common words " + ("zorkling" if i % 5 == 0 else "calm")) for i in range(200)], "label int, text string")
    lexicon = toxicity.learn_lexicon(rows)
    assert "zorkling" in lexicon and "zorkl*" in lexicon and "common" not in lexicon and "calm" not in lexicon


def test_threats_in_other_forms():
    g = toxicity.Grammar({})
    for text in ["you will be killed", "they will be destroyed", "he was beaten", "killing them", "du wirst getötet"]:
        assert np.flatnonzero(g.measure(text.encode())[: toxicity.MARKS]).tolist() == [toxicity.TARGETED], text
    for text in ["they kill", "he beats it", "killed", "the law was destroyed"]:
        assert g.measure(text.encode()).sum() == 0, text


def test_paths_equal_an_enumeration_of_the_rules():
    """Every path's mark and weight, by the rules read off the symbols one mention at a time."""
    t = toxicity
    spell = {t.OTHER: "x", t.INSULT: "blaggard", t.ACTIVE: "kill", t.PASSIVE: "killed", t.TARGET: "you", t.AGENT: "they", t.NEGATION: "not", t.REPORT: "said"}
    g = t.Grammar({"blaggard": 2.0})

    def brute(symbols):
        out = []
        for i, s in enumerate(symbols):
            near = [x for j, x in enumerate(symbols) if j != i and abs(i - j) <= t.SCOPE]
            targeted = t.TARGET in near or (s != t.ACTIVE and t.AGENT in near)
            if s not in (t.INSULT, t.ACTIVE, t.PASSIVE) or (s != t.INSULT and not targeted):
                continue
            weight = (2.0 if s == t.INSULT else 1.0) * (1.0 if targeted else t.WITHOUT_TARGET)
            negated, reported = t.NEGATION in symbols[max(0, i - t.SCOPE) : i], t.REPORT in symbols[:i]
            weight *= (t.IN_NEGATION if negated else 1) * (t.IN_REPORT if reported else 1)
            out.append((t.BOTH if negated and reported else t.NEGATED if negated else t.REPORTED if reported else t.TARGETED if targeted else t.PLAIN, weight))
        return out

    r = random.Random(2)
    clauses = [r.choices(list(spell), k=r.randrange(9)) for _ in range(4000)]
    for symbols in clauses:
        assert g.paths(" ".join(spell[s] for s in symbols).encode()) == brute(symbols), symbols
    text = ". ".join(" ".join(spell[s] for s in symbols) for symbols in clauses[:50])
    want = np.zeros(t.MARKS)
    for symbols in clauses[:50]:
        for mark, weight in brute(symbols):
            want[mark] += weight
    assert np.allclose(g.measure(text.encode()), np.append(np.log1p(want), np.log1p(sum(bool(brute(x)) for x in clauses[:50]))))


def test_quality_measure_equals_plain_compression():
    import zstandard

    good, bad = (quality.build([" ".join(R.choices(WORDS[:6] if k else WORDS[6:], k=150)).encode() for _ in range(300)]) for k in (1, 0))
    text = " ".join(R.choices(WORDS[:6], k=900)).encode()

    def size(d):
        z = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), level=quality.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(z.compress(text[i : i + 1024])) for i in range(0, len(text), 1024))

    d = 100 * (size(bad) - size(good)) / (size(bad) + size(good))
    assert np.allclose(quality.Sizes(good, bad).measure(text), [d, d], rtol=0.1) and d > 5
