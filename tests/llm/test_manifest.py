import hashlib
import zlib

from pyspark.sql import functions as F
from scenequarry.llm import manifest

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """Root, and for each node what stands left and right of it, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = p // 3 * 3
            paths[i].append(("".join(nodes[run:p]), "".join(nodes[p + 1 : run + 3])))
        nodes = [sha("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]
        at = [p // 3 for p in at]
    return nodes[0], paths


def by_loops(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = climb([leaf_of(r) for r in groups[s]])
    root, over = climb([trees[s][0] for s in names])
    out = []
    for s, above in zip(names, over, strict=True):
        for r, path in zip(groups[s], trees[s][1], strict=True):
            path = path + above
            x = leaf_of((*r[:4], r[4].replace("\n", ""))) if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else leaf_of(r)
            for left, right in path:
                x = sha(left + x + right)
            out.append(str((r[0], leaf_of(r), trees[s][0], root, sha("".join(a + b for a, b in path)), x, x == root)))
    return sorted(out)


def run(df):
    tamper = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return sorted(str(tuple(r)) for r in manifest.manifest(df, tamper, F.translate("text", "\n", "")).collect())


def test_rows(spark):
    text = lambda i: f"text {i}\nline" if i % 3 else f"text {i}"
    rows = [(i, "hot", "en", 3, text(i)) for i in range(2300)]  # more than 3 ** 7: three passes of blocks
    rows += [(5000 + i, f"s{i % 4}", None if i % 5 else "fr", i, text(i)) for i in range(37)] + [(6000 + i, "nine", "en", 1, "\n") for i in range(9)] + [(6100 + i, "ten", "en", 1, "") for i in range(10)]
    rows += [(7000, None, None, None, None), (None, None, None, None, "a\nb"), (7001, "", "", -1, ""), (7002, "Ärger", "de", 1, "ü\n" * 200_000), (7002, "Ärger", "de", 1, "ü\n" * 200_000), (7002, "Ärger", "de", 2, "other")]
    df = spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], FIELDS + ", pos int, grp string, hash string, path string").repartition(5)
    assert run(df) == by_loops(rows)


def test_few_rows(spark):
    one = [(1, "a", "en", 1, "x\ny")]
    for rows in (one, [*one, (2, "a", "en", 1, "x\ny")], [*one, (2, "b", None, None, None)], one * 4):
        assert run(spark.createDataFrame(rows, FIELDS)) == by_loops(rows)
    assert run(spark.createDataFrame([], FIELDS)) == []
