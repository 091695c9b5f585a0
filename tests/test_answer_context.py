"""The cap per paper holds only in pools of more than one paper."""

from citeweave.plans import pipelines


def test_single_paper_pools_have_no_cap(spark):
    rows = [("one", i, "A", f"s{i}", 100, 1 - i / 10, 0.0, 0.0) for i in range(6)] + [("two", i, "B" if i == 9 else "A", f"s{i}", 100, 1 - i / 10, 0.0, 0.0) for i in (0, 1, 2, 3, 4, 9)]
    df = spark.createDataFrame(rows, "q string, doc long, paper string, section string, length long, dense double, bm25 double, boost double")
    got = {r["q"]: r["refs"] for r in pipelines.answer_context(df, ["q"], "doc", "paper").collect()}
    assert got == {"one": ["0", "1", "2", "3", "4", "5"], "two": ["0", "1", "2", "9"]}
