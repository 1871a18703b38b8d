"""The workflow selection against plain Python, and retried batches of the inventory stream."""

import random

import pytest

from tracewell.functions import candidates
from tracewell.operators import context
from tracewell.streaming.incremental import inventory_step, inventory_stream


def plain(items, workflow, total, caps):
    budget, order = max(120, total - 220), context.CATEGORY_ORDER.get(workflow, context.OTHER_ORDER)
    weights = candidates.WORKFLOWS.get(workflow, candidates.WORKFLOWS["documentation"])
    taken, counts, used = [], dict.fromkeys(order, 0), 0

    def attempt(item):
        nonlocal used
        id_, category, _, cost = item
        if id_ in taken or counts[category] >= caps.get(category, 0) or (used + cost > budget and taken):
            return
        taken.append(id_)
        counts[category] += 1
        used += cost

    known = [x for x in items if x[1] in order]
    for category in order:
        mine = sorted((x for x in known if x[1] == category), key=lambda x: (-x[2], x[0]))
        if mine:
            attempt(mine[0])
    for item in sorted(known, key=lambda x: (-int(x[2] * weights[x[1]] + 0.5), x[0])):
        attempt(item)
    return taken


@pytest.mark.parametrize("workflow", ["errorAnalysis", "security", "unknown"])
def test_selection_is_that_of_the_rule(spark, workflow):
    r = random.Random(workflow)
    for total, dear in ((600, 5), (330, 300), (0, 500)):
        items = [(k, r.choice([*context.OTHER_ORDER, "other"]), float(r.randrange(60)), r.choice([0, r.randrange(60), r.randrange(60), r.randrange(dear + 1)])) for k in range(300)]
        caps = {"sql": 3, "calls": 2, "fileUsage": 0, "errorPaths": 4, "conditionals": 1 if total else 9}
        frame = spark.createDataFrame(items, "id long, category string, score double, cost long")
        got = context.workflow_selection(frame, workflow, total, caps).orderBy("place").collect()
        assert [x["id"] for x in got] == plain(items, workflow, total, caps)


def test_first_item_is_taken_beyond_the_budget(spark):
    items = spark.createDataFrame([(1, "sql", 9.0, 500), (2, "calls", 8.0, 10), (3, "other", 99.0, 1)], "id long, category string, score double, cost long")
    assert [(r["id"], r["place"]) for r in context.workflow_selection(items, "security", 0, {"sql": 1, "calls": 1}).collect()] == [(1, 1)]
    assert context.workflow_selection(items.limit(0), "security", 0, {"sql": 1}).count() == 0


def test_a_retried_batch_changes_nothing(spark, tmp_path):
    write = lambda rows, n: spark.createDataFrame(rows, "root string, path string, hash string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")
    seen = []
    for n, rows in enumerate([[("r", "a", "1"), ("r", "b", "1")], [("r", "a", "2")]]):
        write(rows, n)
        stream = spark.readStream.schema("root string, path string, hash string").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        writer = inventory_stream(stream, f"{tmp_path}/state", f"{tmp_path}/out").trigger(availableNow=True)
        writer.start().awaitTermination()
        seen.append(sorted((r["batch"], r["path"], r["state"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()))
    assert seen[0] == [(0, "a", "added"), (0, "b", "added")]
    assert seen[1] == [(0, "a", "added"), (0, "b", "added"), (1, "a", "changed"), (1, "b", "deleted")]
    frame = lambda rows: spark.createDataFrame(rows, "root string, path string, hash string")
    step = inventory_step(f"{tmp_path}/state2", f"{tmp_path}/out2")
    for number, rows in ((0, [("r", "a", "1")]), (0, [("r", "a", "1")]), (1, [("r", "a", "2")]), (1, [("r", "a", "2")])):
        step(frame(rows), number)
    assert sorted((r["batch"], r["state"]) for r in spark.read.parquet(f"{tmp_path}/out2").collect()) == [(0, "added"), (1, "changed")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        inventory_step(f"{tmp_path}/state3", f"{tmp_path}/out3")(frame([("r", "a", "1")]), 5)
