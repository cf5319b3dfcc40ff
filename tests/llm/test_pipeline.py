import hashlib

import corpus_pipeline
from scenequarry.llm import packing


def test_stages_and_run(spark, tmp_path):
    say = {"en": "the cat and the dog went to the house with their friends on day", "fr": "le chat et le chien sont alles a la maison avec leurs amis le jour"}
    rows = [(i, f"{say[x]} {i} " * 3 + hashlib.md5(str(i).encode()).hexdigest()[:6], x) for i, x in enumerate(["en", "fr"] * 30)]
    item = "a bench passage that has more than thirteen words in it so that one window fits well"
    rows += [(100, "12 34", "en"), (101, None, "en"), (102, rows[0][1], "en"), (103, f"{item} the dog", "en"), (104, "the dog of the house has password = abcdefghijklmnop and their friends", "en")]
    docs = [(i, t, x, "s", len(t or "")) for i, t, x in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.schema.names == df.schema.names, name
        out.write.parquet(f"{tmp_path}/{i}")
        df = spark.read.parquet(f"{tmp_path}/{i}")
        seen[name] = {r.doc_id: r for r in df.collect()}
    assert set(r[0] for r in docs) - set(seen["language"]) == {100, 101}
    words = {i: r.text.lower().split() for i, r in seen["language"].items()}
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    assert 102 not in seen["near_duplicates"] and 0 in seen["near_duplicates"]
    linked = {i for i, x in shingles.items() for j, y in shingles.items() if j < i and len(x & y) >= 0.8 * len(x | y)}
    assert set(shingles) - set(seen["near_duplicates"]) == linked
    assert set(seen["near_duplicates"]) - set(seen["decontamination"]) == {103}
    assert set(seen["secrets"]) == set(seen["decontamination"])
    assert "[assign]" in seen["secrets"][104].text and seen["secrets"][104].n_chars == len(seen["secrets"][104].text)
    assert set(seen["packing"]) == set(seen["secrets"])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole.collect()} == {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect()}
    assert df.agg({"length": "max"}).first()[0] <= packing.CAPACITY


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, repeated and null ids, a very long text, columns with names that stages use inside, and no rows at all."""
    say = "the cat and the dog went to the house with their friends on the day"
    long = " ".join(f"{say} {hashlib.md5(str(i).encode()).hexdigest()[:5]}" for i in range(4000))
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, digest string, random string, __fp long"
    other = lambda i: " ".join(w[:5] + "e" for w in (hashlib.md5(f"{i} {k}".encode()).hexdigest() for k in range(14)))
    rows = [(i, f"{say} {other(i)}", "en") for i in range(30)] + [(7, "another text of the house and the dog", "en"), (None, f"the dog of the house {other(99)}", None), (50, None, "en"), (51, "", None), (52, long, "en"), (52, long, "en")]
    docs = spark.createDataFrame([(*r, "s", len(r[1] or ""), "k", "r", "d", "x", 1) for r in rows], schema)
    item = spark.createDataFrame([(1, "nothing of this stands anywhere in the texts of the table that is read here")], "item_id long, text string")
    item.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, df in (("some", docs), ("none", docs.limit(0))):
        for i, (stage_name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, str(tmp_path))
            last = i == len(corpus_pipeline.STAGES) - 1
            assert last or out.schema.names == docs.schema.names, stage_name
            out.write.parquet(f"{tmp_path}/{name}{i}")
            df = spark.read.parquet(f"{tmp_path}/{name}{i}")
            if stage_name == "near_duplicates" and name == "some":
                ids = sorted(str(r.doc_id) for r in df.collect())
                assert ids == sorted([*map(str, range(30)), "7", "52", "None"])
        assert (df.count() > 0) == (name == "some")
