"""Every record of a title group has its row, those with equal titles too."""

from citeweave.operators import impact


def test_title_groups_hold_every_record(spark):
    long = " ".join(f"w{i}" for i in range(13))
    near = " ".join(f"w{i}" for i in range(12)) + " other"
    rows = [(1, "Alone here"), (2, "Same words"), (3, "words, same"), (4, "SAME words"), (5, near), (6, long), (7, long), (8, near), (9, None), (10, " ")]
    df = spark.createDataFrame(rows, "rec_id long, title string")
    got = {r["id"]: r["component"] for r in impact.title_groups(df).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 5, 6: 5, 7: 5, 8: 5}
    assert {tuple(r) for r in impact.title_members(df).collect()} == {(1, 1, 1), (2, 2, 3), (3, 2, 3), (4, 2, 3), (5, 5, 2), (8, 5, 2), (6, 6, 2), (7, 6, 2)}
    assert impact.title_groups(df.limit(0)).count() == 0
