from pyspark.sql import functions as F

from marginalia.functions import richtext as rt
from marginalia.functions import text as t
from marginalia.operators import resolve


def runs(spark, *pieces):
    return spark.createDataFrame([([(a, b) for a, b in pieces],)], f"r {rt.RUNS}")


def shown(df, column):
    return df.select(column.alias("x")).first().x


def test_runs(spark):
    df = runs(spark, ("a ", True), ("b", True), ("", False), (" c<", False))
    r = F.col("r")
    assert shown(df, rt.markup(rt.merged(r))) == "*a b* c<"
    assert shown(df, rt.html(rt.merged(r))) == "<em>a b</em> c&lt;"
    assert shown(df, rt.text_of(r)) == "a b c<"
    assert shown(df, rt.markup(rt.merged(rt.sliced(r, F.lit(1), F.lit(4))))) == "* b* "
    assert shown(df, rt.markup(rt.visible(r))) == "*a* *b* c<"
    assert shown(df, rt.markup(rt.appended(r, rt.styled(F.lit("d"), False)))) == "*a b* c<d"
    assert shown(df, rt.styled(F.lit(""))) == []
    spaces = runs(spark, (" ", True), ("x", True), (" \n", True))
    assert shown(spaces, rt.markup(rt.visible(r))) == "*x*"
    same = spark.createDataFrame([([("x", True), (" ", True), ("y", True)], [("x", True), (" ", False), ("y", True)], [("x y", False)])], f"a {rt.RUNS}, b {rt.RUNS}, c {rt.RUNS}")
    assert not shown(same, rt.changed(F.col("a"), F.col("b"))) and shown(same, rt.changed(F.col("a"), F.col("c")))


def test_more_scalars(spark):
    one = lambda c, v: spark.range(1).select(F.lit(v).alias("v")).select(c.alias("x")).first().x
    v = F.col("v")
    assert one(t.redact_ids(v), "see 550E8400-e29b-41d4-a716-446655440000.") == "see 550E8400…."
    assert one(t.year_in(v), "2 May 1999, 2001") == "1999" and one(t.year_in(v), "x") is None
    assert one(t.surname(v), "Lee, Ann") == "Lee" and one(t.surname(v), " Ann Lee") == "Lee"
    title, year = t.title_and_year(v, F.lit(None).cast("string"))
    assert (one(title, "Forest Act 1993"), one(year, "Forest Act 1993"), one(title, "Forest Act")) == ("Forest Act", "1993", "Forest Act")
    assert one(t.case_name(v), "*Ash Pty. Ltd. vs. Birch (No 2)*") == "Ash Pty Ltd v Birch [No 2]"


def test_repeats_resolve_along_chains(spark):
    rows = [(1, 1, "a", False), (2, 1, None, True), (3, 1, None, True), (4, 1, "b", False), (4, 2, None, True), (5, 1, None, True), (7, 1, None, True), (8, 1, "c", False), (9, 1, None, True)]
    df = spark.createDataFrame([("d", *r) for r in rows], "doc string, note int, seg int, key string, is_repeat boolean")
    got = {(r.note, r.seg): r.resolved for r in resolve.resolve_repeats(df).collect()}
    # Note 5 follows a note with two mentions, note 7 follows no note 6.
    assert got == {(1, 1): "a", (2, 1): "a", (3, 1): "a", (4, 1): "b", (4, 2): "b", (5, 1): None, (7, 1): None, (8, 1): "c", (9, 1): "c"}


def test_names_mean_the_earliest_clear_note(spark):
    rows = [(1, "Lee", "s1"), (1, "Lee", "s2"), (2, "Lee", "s2"), (3, "Lee", "s1"), (4, "Lee", "s9"), (4, "Kim", "s3")]
    df = spark.createDataFrame([("d", *r) for r in rows], "doc string, note int, name string, source string")
    got = {(r.note, r.name): r.target_source for r in resolve.earliest_named(df).collect()}
    assert got == {(1, "Lee"): None, (2, "Lee"): None, (3, "Lee"): "s2", (4, "Lee"): "s2", (4, "Kim"): None}
