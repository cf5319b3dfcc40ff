import zlib
from collections import defaultdict

import numpy as np
import pytest
from scenequarry.llm import packing, tokens

TEXTS = [None, "", "one two three", "word " * 5000, "one two three", "x y z " * 100, "ab<|endoftext|>cd"] + [f"doc {i} " * (i * 7 % 90 + 1) for i in range(60)]


def check(rows, texts, capacity):
    tok = tokens.tokenizer(tokens.vocabulary_path())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        got = sorted(by_doc[i or None], key=lambda r: r.piece)
        assert [r.start for r in got] == list(range(0, len(ids), capacity))
        for r in got:
            cut = ids[r.start : r.start + r.length]
            assert r.length == min(capacity, len(ids) - r.start) and r.ids_crc32 == zlib.crc32(np.array(cut, "<u4").tobytes())
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_seq)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pieces_and_sequences(spark, capacity):
    docs = spark.createDataFrame([(i or None, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, piece string").repartition(5)
    rows = packing.pack(docs, capacity=capacity).collect()
    used = check(rows, TEXTS, capacity)
    assert used <= 1.05 * -(-sum(r.length for r in rows) // capacity) + 1


def test_plan_covers_the_histogram_near_the_bound():
    rng = np.random.default_rng(1)
    sizes = np.minimum(2048, rng.lognormal(6, 1, 200_000).astype(int) + 1)
    histogram = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True))
    got = packing.plan(histogram)
    held = defaultdict(int)
    for config, n in got:
        assert sum(x * a for x, a in config) <= 2048
        for x, a in config:
            held[x] += a * n
    assert dict(held) == histogram
    assert sum(n for _, n in got) <= 1.002 * sizes.sum() / 2048 + 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
