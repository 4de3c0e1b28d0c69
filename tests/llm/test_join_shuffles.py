"""What the n-gram join sends around: keys once for the copies of a task, points once for all rounds."""

import contextlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyfield.llm import ngram_join as N


def text(seed: int, n: int = 60) -> str:
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n))


def signed(texts: list[str]) -> list[dict]:
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": [t]}) for i, t in enumerate(texts)]
    return [r for b in N._signatures(3, 90, batches) for r in b.to_pylist()]


def test_only_the_first_copy_of_a_task_has_keys(monkeypatch):
    one, two, three = text(1), text(2), text(3)
    rows = signed([one, two, one.upper(), one, ""])
    assert [bool(r["keys"]) for r in rows] == [True, True, False, False, False]
    assert [r["point"] is not None for r in rows[:4]] == [True, True, False, False]
    assert rows[0]["digest"] == rows[2]["digest"] and rows[0]["n"] == rows[3]["n"] == 58
    monkeypatch.setattr(N, "SEEN", 2)  # what was forgotten has keys again
    assert [bool(r["keys"]) for r in signed([one, two, one, three, one, one])] == [True, True, False, True, True, False]


def test_met_takes_an_id_of_a_key_once():
    rows = [(1, 5), (1, 5), (2, 5), (2, 5), (2, 6), (3, 1), (4, 7), (4, 8), (4, 8)]
    for size in (1, 2, 4, 20):
        batches = [pa.RecordBatch.from_pydict({"key": [k for k, _ in rows[i : i + size]], "id": [v for _, v in rows[i : i + size]]}) for i in range(0, len(rows), size)]
        got = [(r["key"], r["id"]) for b in N._met(batches) for r in b.to_pylist()]
        assert got == [(2, 5), (2, 6), (4, 7), (4, 8)]


def test_copies_and_near_copies_in_many_tasks(spark):
    """Copies of a text and of its edit lie in all of eight tasks; null and repeated doc_ids among them."""
    a = text(4, 120)
    b = a.replace(a.split()[60], "edit", 1)
    rows = [(i, (a, b, text(100 + i))[i % 3]) for i in range(48)] + [(None, a), (7, a), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = sorted(((r["doc_id"], r["component_id"]) for r in N.jaccard_components(docs, 3, 90).collect()), key=str)
    want = [(i, 0 if i % 3 < 2 else i) for i in range(48)] + [(None, 0), (7, 0), (None, None)]
    assert got == sorted(want, key=str)


def test_points_are_joined_as_they_lie(spark):
    rows = [(i, 3, b"p" * 8, b"o" * 8) for i in range(50)]
    points, drop = N._by_id(spark.createDataFrame(rows, "id long, n long, point binary, odd binary"))
    try:
        pairs = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 5).alias("b"))
        said = io.StringIO()
        with contextlib.redirect_stdout(said):
            N._likely(pairs, points, 90).explain()
        assert said.getvalue().count("hashpartitioning(a#") == 1 and said.getvalue().count("hashpartitioning(b#") == 1  # the pairs, not the points
        assert sorted(r["id"] for r in points.collect()) == list(range(50))
    finally:
        drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("ngram_points_")]
