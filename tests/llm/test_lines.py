import pytest
from scenequarry.llm.lines import without_frequent_lines

BLANK = " \t\n\x0b\f\r"
AZ = {c: c + 32 for c in range(65, 91)}


def by_loops(rows, least):
    key = lambda line: line.strip(BLANK).translate(AZ)
    docs = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            docs.setdefault(key(line), set()).add(i)
    bad = {k for k, v in docs.items() if k and len(v) >= least}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in bad]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("broadcast_bytes", [64 << 20, 0])
def test_odd_rows(spark, broadcast_bytes):
    rows = [(i, f"own {i}\n  Shared\tLINE \r\n\n \nÄ Zeile{' ' * (i % 3)}\nlast") for i in range(9)]
    rows += [(20, "SHARED\tline"), (21, "nine\nshared\tline\x0b\n"), (21, "nine\nshared\tline\x0b\n"), (21, "other text, same id\nLAST"), (None, "last"), (None, "no id\nlast"), (30, None), (31, ""), (32, "\n\n"), (33, "ä zeile")]
    rows += [(40, "\n".join(f"long {k}\nlast" for k in range(30_000)))]
    docs = spark.createDataFrame([(*r, "x", [1], 2, "y", "z") for r in rows], "doc_id long, text string, key string, lines array<int>, pos int, h1 string, r1 string")
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept) for r in without_frequent_lines(docs, 10, 1, broadcast_bytes).collect())
    assert got == by_loops(rows, 10)
    kept = {r[0]: r for r in got}
    assert kept["20"][2:] == (1, "") and kept["0"][3] == "own 0\n\n \nÄ Zeile" and kept["33"][2] == 0
    assert without_frequent_lines(docs.limit(0)).count() == 0


def test_least_chars(spark):
    docs = spark.createDataFrame([(i, "ab\nabc") for i in range(3)], "doc_id long, text string")
    assert {r.kept for r in without_frequent_lines(docs, 3, 3).collect()} == {"ab"}
