"""Usage folded by the state of a stream."""

import json
import random

from pyspark.sql import functions as F

from knotwork.streaming import folding, recalls


def test_any_division_and_order_gives_what_the_whole_ledger_gives(spark, tmp_path):
    rng = random.Random(5)
    lines = [{"ts": f"2024-05-{1 + rng.randrange(28):02d}T{rng.randrange(24):02d}:00:00Z", "q": rng.choice([None, *(f"q{i:02d}" for i in range(9))]), "ids": [rng.choice("aaaabc") for _ in range(rng.randrange(3))]} for _ in range(120)]
    (tmp_path / "in").mkdir()
    out = {}

    def keep(batch, _):
        out.update({r.id: r for r in batch.collect()})

    for number in range(3):  # each time a new query over the same checkpoint
        (tmp_path / f"in/{number}.json").write_text("".join(json.dumps(x) + "\n" for x in lines[number::3]))
        stream = folding.folded(recalls.ledger(spark, f"{tmp_path}/in"), most=5)
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(240)
    used = [(i, x["q"], x["ts"]) for x in lines for i in x["ids"]]
    want = {i: (sum(u[0] == i for u in used), sorted({q for j, q, _ in used if j == i and q})[:5], max(t for j, _, t in used if j == i)) for i in {u[0] for u in used}}
    shown = lambda r: (r.recall_count, r.recall_queries, r.last_recalled.strftime("%Y-%m-%dT%H:%M:%SZ"))
    assert {i: shown(r) for i, r in out.items()} == want and not any(r.quiet for r in out.values())
    table = spark.createDataFrame([*used, (None, "q", "2024-05-01T00:00:00Z")], "id string, q string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert {r.id: shown(r) for r in folding.folded(table, most=5).collect()} == want
    assert folding.folded(table.limit(0)).isEmpty()


def test_a_node_that_falls_quiet_gets_its_row_once_more(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, batches = [], [[("2024-05-01", "a"), ("2024-05-03", "b")], [("2024-05-08", "a")], [("2024-05-20", "c"), (None, "d")], [("2024-05-20", "c")]]

    def keep(batch, _):
        out.extend((r.id, r.recall_count, r.quiet) for r in batch.collect())

    for number, rows in enumerate(batches):
        (tmp_path / f"in/{number}.json").write_text("".join(json.dumps({"ts": t and f"{t}T00:00:00Z", "q": None, "ids": [i]}) + "\n" for t, i in rows))
        stream = folding.folded(recalls.ledger(spark, f"{tmp_path}/in"), quiet_days=7)
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(240)
    assert sorted(x for x in out if x[2]) == [("a", 2, True), ("b", 1, True)]
    assert ("c", 2, False) in out and ("a", 2, False) in out
