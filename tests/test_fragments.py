"""Fragments under a budget: where the first is cut, and fragments of one rank."""

from lodestream.operators import context


def test_a_cut_at_a_whole_number_of_characters(spark):
    """The share of 4 * n characters of n tokens is 240 for every n; 60 / n rounded first gives 239 for some."""
    lengths = [4 * n for n in range(61, 480)]
    rows = spark.createDataFrame([(k, 1, "x" * k) for k in lengths], "query_id long, rank long, text string")
    got = {r.query_id: len(r.text) for r in context.fragments(rows, "text", 60).collect()}
    assert got == {k: 240 for k in lengths}


def test_fragments_of_one_rank_stand_or_fall_together(spark):
    rows = spark.createDataFrame([(1, 1, "a" * 40), (1, 2, "b" * 120), (1, 2, "c" * 120), (2, 1, "d" * 160), (2, 1, "e" * 160)], "query_id long, rank long, text string")
    got = sorted((r.query_id, r.text[0], len(r.text)) for r in context.fragments(rows.repartition(3), "text", 60).collect())
    assert got == [(1, "a", 40), (2, "d", 160), (2, "e", 160)]
