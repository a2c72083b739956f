"""The digest index over several batches."""

from specimen_spark.llm import exact_dedup


def test_groups_of_later_batches(spark):
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    rows = lambda df: sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect())
    index = exact_dedup.DigestIndex(spark)
    assert rows(exact_dedup.exact_groups(docs((1, "a"), (2, "b")), index)) == [(1, 1, 1, True), (2, 2, 1, True)]
    got = rows(exact_dedup.exact_groups(docs((3, "a"), (4, "c"), (5, "a"), (6, "c")), index))
    assert got == [(3, 1, 3, False), (4, 6, 2, False), (5, 1, 3, False), (6, 6, 2, True)]
    assert rows(exact_dedup.exact_groups(docs((7, "c"), (8, None), (9, "")), index)) == [(7, 6, 3, False), (8, 9, 2, False), (9, 9, 2, True)]
    assert index.read().count() == 4
    hot = docs(*[(i, "a") for i in range(100, 400)], (400, "z"))
    assert rows(exact_dedup.exact_groups(hot, index))[0] == (100, 1, 301, False)
    assert exact_dedup.exact_groups(docs(), index).count() == 0
