"""Inverted lists: all queries, measured recall, all lists probed."""

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_lists_are_probed_until_recall_is_reached(spark):
    found = entry.queries()["ivf_search"](spark, SF).collect()
    exact = entry.queries()["ivf_search_all_lists"](spark, SF).collect()
    assert len({r["query_id"] for r in exact}) == 10 and len(exact) == len(found) == 200
    pairs = lambda rows: {(r["query_id"], r["vec_id"]) for r in rows}
    recall = len(pairs(found) & pairs(exact)) / 200
    stated = [r["recall"] for r in entry.queries()["ivf_recall"](spark, SF).orderBy("probes").collect()]
    assert recall >= 0.9 and min(r for r in stated if r >= 0.9) == recall and stated[-1] == 1.0
