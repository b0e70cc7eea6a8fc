"""Shares of the questions' terms, worked out in the scan of the vectors."""

from docweave.operators import vectors


def test_overlap_beside_the_cosine(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], ["a", "b"], 7), (2, [0.0, 1.0], ["b", "x", "y"], 8), (3, [1.0, 1.0], [], 7), (4, [1.0, 1.0], None, 7), (5, None, ["a"], 7)], "id long, embedding array<double>, terms array<string>, label int")
    got = vectors.cosines(rows, [(10, [2.0, 0.0]), (20, [0.0, 1.0]), (30, [1.0, 1.0])], ("label",), {10: ["a", "b", "c", "d"], 20: ["b"]}).collect()
    assert {(r.question, r.id): (r.label, round(r.cosine, 6), r.overlap) for r in got} == {
        (10, 1): (7, 1.0, 0.5), (10, 2): (8, 0.0, 0.25), (10, 3): (7, 0.707107, 0.0), (10, 4): (7, 0.707107, 0.0),
        (20, 1): (7, 0.0, 1.0), (20, 2): (8, 1.0, 1.0), (20, 3): (7, 0.707107, 0.0), (20, 4): (7, 0.707107, 0.0),
    }
    assert vectors.cosines(rows, [], ("label",), {}).count() == 0
