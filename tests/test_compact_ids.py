"""Ids that follow from their row are not carried through shuffles; any others stay as they are."""

from pyspark.sql import functions as F

from credsift.functions.keys import finding_id, short_id
from credsift.operators import attribution, dedup, merge
from credsift.schema import FINDING_COLUMNS, FINDING_DDL


def _own():
    return finding_id(F.col("repository"), F.col("file_path"), F.col("secret_value"))


def _rows(spark):
    """Rows with their own id, another's, a free one, digits and none."""
    rows = [(i, "r", f, line, "t", v, "c", [tool]) for i, f, line, v, tool in [
        ("own", "a.py", 1, "AKIA1", "x"), ("own", "a.py", 1, "AK IA1", "y"),
        ("own", "b.py", 9, "other", "x"), ("free", "c.py", 2, "zeta", "x"),
        ("free", "d.py", 2, "eta", "y"), ("AB", "e.py", 3, "theta", "x"), ("ab", "f.py", 4, "iota", "x"),
        ("abc", "g.py", 5, "kappa", "x"), (None, "h.py", 6, "mu", "x"), (None, "i.py", 6, "nu", "y"),
        ("", "j.py", 7, "xi", "x")]]
    found = spark.createDataFrame(rows, FINDING_DDL).coalesce(1)
    found = found.withColumn("seq", F.monotonically_increasing_id())
    own = F.col("id") == "own"
    found = found.withColumn("id", F.when(own, _own()).otherwise(F.col("id")))
    # two rows of one id, though their values differ
    return found.withColumn("id", F.when(F.col("file_path") == "b.py", F.sha2(F.lit("r|a.py|AKIA1"), 256))
                            .otherwise(F.col("id")))


def test_states_hold_no_id_that_follows_from_the_row(spark):
    found = merge.with_norm(_rows(spark))
    states = merge.start_state(found).select("file_path", "best").collect()
    carried = {r.file_path for r in states if r.best.given_id is not None}
    assert carried == {f"{c}.py" for c in "bcdefghij"}
    assert all("id" not in r.best.asDict() for r in states)


def test_rows_of_one_id_are_merged_and_keep_it(spark):
    found = _rows(spark)
    merged = {r.id: (r.file_path, r.found_by) for r in dedup.merge_same_id(found).collect()}
    own = found.filter("file_path = 'a.py'").head().id
    assert merged == {
        own: ("a.py", ["x", "y"]), "free": ("c.py", ["x", "y"]), "AB": ("e.py", ["x"]),
        "ab": ("f.py", ["x"]), "abc": ("g.py", ["x"]), None: ("h.py", ["x", "y"]), "": ("j.py", ["x"])}
    unique = {r.id for r in dedup.dedup_findings(found).collect()}
    assert unique == set(merged)
    keys = found.select(short_id().alias("k"), "id").distinct()
    assert keys.select("k").distinct().count() == keys.select("id").distinct().count() == 7


def test_attribution_writes_no_id_that_follows_from_the_row(spark, monkeypatch):
    found = _rows(spark).withColumn("commit_hash", F.lit("")).withColumn("blob_id", F.lit("b"))
    blame = spark.createDataFrame(
        [("r", "HEAD", f"{c}.py", 1, 5, "new") for c in "abcdef"],
        "repository STRING, revision STRING, file_path STRING, line_start INT, line_end INT, "
        "commit_hash STRING",
    )
    written = []
    cut = attribution.cut

    def keep(df, label, **options):
        written.append(cut(df, label, **options))
        return written[-1]

    monkeypatch.setattr(attribution, "cut", keep)
    got = attribution.attribute(found, blame)
    assert got.columns == found.columns
    want = found.withColumn("commit_hash", F.when(
        F.col("line_number").between(1, 5) & F.col("file_path").rlike("^[a-f]"), "new").otherwise(""))
    rows = lambda df: sorted(map(str, df.select(*FINDING_COLUMNS, "seq").collect()))
    assert rows(got) == rows(want)
    assert written[0].filter("file_path = 'a.py' AND id IS NOT NULL").count() == 0
