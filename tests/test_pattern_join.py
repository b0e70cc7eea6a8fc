"""Whole words of a dictionary of several slices are joined, not sought slice by slice."""

from docweave.operators import patterns


def test_texts_are_read_once_for_many_patterns(spark):
    texts = spark.createDataFrame([(1, "the t1 or any t22; _t1 t1-t3 t 22"), (2, None), (3, "é t1é (t3) t1"), (3, "t1 or any")], "id long, text string")
    asked = spark.createDataFrame([(p,) for p in ("t1", "t22", "t3", "t", "t1 or any", "t1-t3", "(t3)", "x", "", None, "t1", "a b c d e f g h i")], "pattern string")
    find = lambda most: patterns.occurrences(texts, asked, True, most)
    few, many = find(1 << 20), find(8)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    assert many._jdf.queryExecution().analyzed().toString().count("MapInArrow") <= 3  # before, one for each of five slices
