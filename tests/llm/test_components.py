import random
import time

import pytest
from scenequarry.llm import simhash

R = random.Random(11)
#: A path, a star, a tree, a circle, two pairs; names in no order.
SHAPES = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200 + i, 200 + i // 3) for i in range(1, 50)] + [(300 + i, 300 + (i + 1) % 9) for i in range(9)] + [(400, 401), (410, 411)]
NAMES = dict(zip(range(500), R.sample(range(-(1 << 40), 1 << 40), 500), strict=True))
EDGES = [(max(NAMES[a], NAMES[b]), min(NAMES[a], NAMES[b])) for a, b in SHAPES]


def brute(edges):
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return {x: r for x, r in root.items() if x != r}


@pytest.fixture
def wide(spark):
    """Sixty partitions, which Spark doesn't join."""
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def tasks_of(spark, group, action):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    time.sleep(2)  # the tracker hears of tasks later
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return out, sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))


def test_a_small_table_stays_with_few_tasks(wide):
    edges = wide.createDataFrame(EDGES, "a long, b long").repartition(60).checkpoint()
    got, n = tasks_of(wide, "components", lambda: simhash.components(edges).collect())
    assert {r.node: r.root for r in got} == brute(EDGES) and len(got) == len(brute(EDGES))
    assert n < 1500, n


@pytest.mark.parametrize("small", [0, 1000])
def test_tables_of_any_size_give_the_same(spark, small):
    for edges in ([], EDGES[:1], EDGES[40:99], EDGES + EDGES[:7]):
        got = simhash.components(spark.createDataFrame(edges, "a long, b long"), small).collect()
        assert {r.node: r.root for r in got} == brute(edges) and len(got) == len(brute(edges))
