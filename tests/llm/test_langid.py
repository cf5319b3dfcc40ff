from pyspark.sql import functions as F
from scenequarry.llm import langid
from scenequarry.llm.common import is_held_out

SAY = {"en": "the cat and the dog went to the house with their friends", "fr": "le chat et le chien sont allés à la maison avec leurs amis"}


def table(spark):
    rows = [(i, f"{SAY[x]} {i}", x, "s") for i in range(40) for x in SAY]
    rows += [(None, "the house and the friends", None, "s"), (1001, None, "en", "s"), (1002, "", "en", "s"), (1003, "12 34 !?", "en", "s"), (1004, "the dog " * 100_000, None, "s"), (1005, "日本", None, "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)


def test_predictions(spark):
    docs = table(spark)
    model = langid.train(docs, ~is_held_out("doc_id", 4, 2))
    got = langid.predict(docs, model)
    assert got.count() == docs.count()
    wrong = got.join(docs.filter("doc_id < 1000").select("doc_id", "lang").distinct(), "doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_set("lang_pred")).alias("p")).filter(F.size("p") != 2)
    assert wrong.count() == 0  # each id has one text of either language
    by = {r.doc_id: r for r in got.filter("doc_id > 1000 or doc_id is null").collect()}
    assert by[None].lang_pred == by[1004].lang_pred == "en" and by[1004].score > 0.99
    assert by[1001].lang_pred == by[1002].lang_pred == by[1003].lang_pred == "und" and by[1003].score == 0
    assert by[1005].lang_pred in SAY
    kept = langid.keep_known(docs, model)
    assert kept.schema == docs.schema and {r.doc_id for r in docs.select("doc_id").subtract(kept.select("doc_id")).collect()} >= {1001, 1002, 1003}
    assert kept.filter("doc_id < 1000").count() == 80


def test_no_labels_and_no_rows(spark):
    docs = table(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.predict(docs, langid.train(docs, F.lit(True))).collect()} == {"und"}
    assert langid.predict(docs.limit(0), langid.train(docs.limit(0), F.lit(True))).count() == 0


def test_blocks_make_little_difference(monkeypatch):
    data = ("é the cat " * 3000).encode()
    n = len(langid.hashed(langid.folded(data), 1 << 15))
    monkeypatch.setattr(langid, "BLOCK", 1000)
    parts = [langid.hashed(langid.folded(x), 1 << 15) for x in langid.blocks(data)]
    assert b"".join(langid.blocks(data)) == data and abs(sum(map(len, parts)) - n) < 200


def test_equals_a_plain_loop(spark):
    """Counts by a dictionary over every n-gram of every training text, then sums of logarithms; equal priors."""
    import collections
    import math

    docs = table(spark)
    rows = [(r.text, r.lang) for r in docs.collect() if r.text is not None]
    counts = {x: collections.Counter() for x in SAY}
    for text, lang in rows:
        if lang is not None:
            counts[lang].update(langid.hashed(langid.folded(text.encode()), langid.BUCKETS).tolist())
    total = {x: sum(c.values()) + 0.1 * langid.BUCKETS for x, c in counts.items()}
    got = {r.text: (r.lang_pred, r.score) for r in docs.join(langid.predict(docs, langid.train(docs, F.lit(True))).withColumnRenamed("score", "p"), "doc_id").select("text", "lang_pred", F.col("p").alias("score")).filter("doc_id > 1000").collect()}
    for text in got:
        if text is None or not any(c.isalpha() for c in text) or len(text) > 10_000:
            continue
        sums = {x: sum(math.log((counts[x][b] + 0.1) / total[x]) for b in langid.hashed(langid.folded(text.encode()), langid.BUCKETS).tolist()) for x in SAY}
        best = max(sums, key=sums.get)
        assert got[text][0] == best and abs(got[text][1] - 1 / sum(math.exp(v - sums[best]) for v in sums.values())) < 1e-4
    model = langid.train(docs, F.lit(True))
    for text, _ in rows[:20]:
        sums = {x: sum(math.log((counts[x][b] + 0.1) / total[x]) for b in langid.hashed(langid.folded(text.encode()), langid.BUCKETS).tolist()) for x in SAY}
        langs, scores = langid.score_batch(model, [text.encode()])
        assert langs == [max(sums, key=sums.get)]
