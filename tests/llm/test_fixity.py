from pyspark.sql import functions as F
from scenequarry.llm import fixity


def pages(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 40 + 1)) for i in range(700)]
    rows += [(None, "http://n", "null id"), (13, None, None), (7, "http://x/7", rows[7][2]), (701, "http://long", "y" * 500_000), (702, "", "")]
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, hash string").repartition(3)


def brute(rows):
    bad = set()
    for r in set(rows):
        if r.page_id is not None and r.page_id % 193 == 7:
            bad.add(("missing", r.page_id))
        elif r.page_id is not None and r.page_id % 97 == 13 and r.html is not None:
            bad.add(("changed", r.page_id))
    return bad


def test_audit_finds_what_differs(spark):
    df = pages(spark)
    got = fixity.audit_pages(df, F.col("page_id") % 97 == 13, F.col("page_id") % 193 == 7).collect()
    want = brute(df.collect())
    assert {(r.kind, r.page_id) for r in got if r.kind != "file"} == want
    files = [r for r in got if r.kind == "file"]
    assert sum(r.n_records for r in files) == df.count() - 1 and sum(r.n_bad for r in files) == len(want)


def test_descent_compares_few_nodes_and_roots_tell(spark):
    at = fixity.placed(pages(spark).select("page_id", F.length("html").cast("long").alias("n_bytes"), F.sha2("url", 256).alias("d")).filter("page_id is not null and n_bytes > 0 and d is not null"), "page_id", "d")
    both = at.select("file", "offset", F.explode(F.array(F.struct(F.lit("a").alias("r"), "d"), F.struct(F.lit("b").alias("r"), F.when(F.col("page_id") == 300, F.lit("x")).otherwise(F.col("d")).alias("d")))).alias("x"))
    tree = fixity.levels(both.select(F.col("x.r").alias("replica"), "file", "offset", F.col("x.d").alias("hash")), range_bytes=256, fan=4)
    found, compared = fixity.audit(tree, "a", "b")
    assert found.count() == 1 and found.first().hash_b == "x"
    assert all(n <= 16 for n in compared) and len(compared) == len(tree)
    assert len({r.hash for r in fixity.roots(tree).collect()}) == 2
    same, few = fixity.audit(tree, "a", "a")
    assert same.count() == 0 and few == []  # equal roots: nothing is compared


def test_a_lost_record_moves_others_without_reporting_them(spark):
    rows = [(i, 100, f"d{i:04d}") for i in range(600)]
    place = lambda r: fixity.placed(spark.createDataFrame(r, "page_id long, n_bytes long, d string"), "page_id", "d")
    a = place(rows)
    b = place([(i, n + (i == 40) * 7, d + ("x" if i == 40 else "")) for i, n, d in rows if i != 20])
    leaf = lambda df, r: df.select(F.lit(r).alias("replica"), "file", "offset", F.col("page_id").alias("id"), F.col("d").alias("hash"))
    assert [r.offset for r in b.filter("page_id in (19, 21, 41)").orderBy("page_id").collect()] == [1900, 2000, 4007]
    found, compared = fixity.audit(fixity.levels(leaf(a, "a").unionByName(leaf(b, "b")), range_bytes=512, fan=4), "a", "b")
    assert {(r.id, r.offset, r.offset_b, r.hash_b) for r in found.collect()} == {(20, 2000, None, None), (40, 4000, 3900, "d0040x")}
    assert compared[-1] < 2 * 256  # one file alone is read down to its records
    back, _ = fixity.audit(fixity.levels(leaf(a, "a").unionByName(leaf(b, "b"))), "b", "a")
    assert {(r.id, r.hash_a) for r in back.collect()} == {(20, None), (40, "d0040x")}


def test_one_id_with_very_many_records(spark):
    rows = [(5, i % 7 + 1, f"{i * 2654435761 % (1 << 32):08x}") for i in range(3000)] + [(6, 9, "00")]
    got = fixity.placed(spark.createDataFrame(rows, "page_id long, n_bytes long, d string"), "page_id", "d").orderBy("offset").collect()
    at = 0
    for r in got:
        assert r.offset == at
        at += r.n_bytes
    assert [(r.page_id, r.d) for r in got] == sorted((i, d) for i, _, d in set(rows))


def test_empty_table(spark):
    assert fixity.audit_pages(pages(spark).limit(0), F.lit(True), F.lit(False)).count() == 0
