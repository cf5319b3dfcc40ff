import hashlib
import re

import pytest
from scenequarry.llm import decontam

ITEMS = [(1, "The quick brown fox jumps over the lazy dog and then it runs far away from here"), (2, "short item"), (3, "one"), (4, ""), (5, None), (6, "!!"), (7, "the quick brown fox jumps over the lazy dog and then it runs far")]
W = "the quick brown fox jumps over the lazy dog and then it runs far away from here"
TEXTS = [
    None, "", "nothing to see at all", f"Before: {W.upper()}!", f"{W} {W}", "a short ITEM, and one more", " ".join(W.split()[:12]), "filler words go on " * 200 + W, "one", "É short item È ONE",
    "the the quick brown fox jumps over the lazy dog and then it runs far", "word " * 60_000 + "short-item",
]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text):
    w, hit, found = words(text), set(), set()
    for i, t in ITEMS:
        x = words(t)
        for k in range(max(1, len(x) - 12)) if x else []:
            win = x[k : k + 13]
            for at in range(len(w) - len(win) + 1):
                if w[at : at + len(win)] == win:
                    hit.update(range(at, at + len(win)))
                    found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("broadcast_bytes", [64 << 20, 0])
def test_equals_brute_force(spark, broadcast_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    table = [(i or None, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again")]
    docs = spark.createDataFrame(table, "doc_id long, text string, n_hit string").repartition(3)
    got = decontam.contamination(docs, items, broadcast_bytes=broadcast_bytes).collect()
    assert len(got) == len(table)
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(TEXTS[r.doc_id or 0]), TEXTS[r.doc_id or 0][:60]
    if broadcast_bytes:
        kept = decontam.keep_clean(docs, items)
        assert kept.columns == docs.columns
        clash = docs.withColumnsRenamed({"n_hit": "key"})
        assert decontam.keep_clean(clash, items).columns == clash.columns and decontam.keep_clean(clash, items).count() == kept.count()
        assert sorted((r.doc_id or 0) for r in kept.collect()) == [i for i, t in enumerate(TEXTS) if not brute(t)[4]]


def test_empty_tables(spark):
    items, docs = spark.createDataFrame(ITEMS, "item_id long, text string"), spark.createDataFrame([(1, W)], "doc_id long, text string")
    assert decontam.contamination(docs.limit(0), items).count() == 0
    assert [r.contaminated for r in decontam.contamination(docs, items.limit(0)).collect()] == [False]
