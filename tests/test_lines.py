"""Neighbours of documents whose ids have gaps."""

from reelmill.plans.labels import _with_next


def test_next_line_over_gaps(spark):
    ids = [1, 5, 1023, 1025, 2047, 5000, 5001, 9000, None]
    df = spark.createDataFrame([(i, f"line {i}") for i in ids], "doc_id long, line string")
    got = {r.doc_id: r.nxt for r in _with_next(df).collect()}
    assert got == {i: f"line {j}" if k + 1 < len(ids) else None for k, (i, j) in enumerate(zip(ids, ids[1:] + [None]))}
