"""What a reviewer found on larger tables, round 4."""

import random

import pyarrow as pa

from loomspark.operators import layout as L
from tests.test_layout import RUN, plain_lines


def test_runs_leave_their_task_as_lines(spark):
    from loomspark.plans.layout import lines

    plan = lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    above, below = plan.split("MapInArrow", 1)
    assert "Exchange" in above and "width" not in above  # what is dealt again are lines
    assert below.count("Exchange") == 1 and "width" not in below.split("Exchange", 1)[1]


def test_lines_go_over_batches_of_any_size(spark):
    rng = random.Random(4)
    rows, x, y = [], 0.0, 0.0
    for seq in range(600):
        page = 1 + seq // 300
        y = y if seq % 300 < 150 else y + rng.choice([0, 0, 0, 3, 5, -14])  # a line over many batches first
        size, text = rng.choice([10.0, 10.0, 12.0, 30.0, 0.0 if seq % 300 > 250 else 10.0]), rng.choice(["", " ", "a", "T", "wo ", " rd", "12", " ", "é　"])
        rows.append(("d", page, seq, x, y, size, 5.0 * len(text), text, seq % 300 > 150 and rng.random() < 0.2))
        x += 5.0 * len(text) + rng.choice([0, 1, 1.4, 1.6, 5])
    names = [c.split()[0] for c in RUN.split(", ")]
    want = [(p, *r) for p in (1, 2) for r in plain_lines([dict(zip(names, r, strict=True)) for r in rows if r[1] == p])]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "7", "100"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = L.assembled_lines(spark.createDataFrame(rows, RUN).repartition(5)).orderBy("page", "line").collect()
            assert [(r["page"], r["line"], r["x"], r["y"], r["right"], r["size"], r["text"]) for r in got] == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_only_the_open_line_is_held():
    names = ["page", "line", "x", "y", "right", "size", "text"]
    given = []

    def runs():
        for i in range(100):  # ten lines a batch, the last of which goes on in the next
            n = range(i * 45, i * 45 + 50)
            given.append(i)
            heights = [float(-((i * 50 + j + 5) // 10)) * 18 for j in range(50)]
            yield pa.RecordBatch.from_arrays([pa.array([1] * 50), pa.array(n), pa.array([6.0 * j for j in n]), pa.array(heights), pa.array([12.0] * 50), pa.array([6.0] * 50), pa.array(["a"] * 50), pa.array([1] * 50)], names=[*names, "tells"])

    sizes = []
    for out in L._assembled(1, names)(runs()):
        sizes.append((len(given), out.num_rows))
    assert sum(n for _, n in sizes) == 501 and sizes[:2] == [(1, 5), (2, 5)]
