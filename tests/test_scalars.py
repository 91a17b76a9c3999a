from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from decklake.functions import scalars as S
from decklake.functions.constants import PALETTE


def one(spark, column, *rows):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(column).collect()]


def test_text(spark):
    x = F.col("x")
    assert one(spark, S.one_line(x), " a \n b ", None, "") == ["a b", None, ""]
    assert one(spark, S.ends_with_punctuation(x), "End. ", "End!", "a;\n", "") == [True, False, True, False]
    assert one(spark, S.without_punctuation(x), "End.,;", "End") == ["End", "End"]
    assert one(spark, S.plain_quotes(x), "‘a’ “b”") == ["'a' \"b\""]
    assert one(spark, S.hex_colour(x), "#a1b2c3", "FFa1b2c3", "xyz", None) == ["A1B2C3", "A1B2C3", None, None]
    assert one(spark, S.points_in(x), "use 10.5 pt here", "none") == [10.5, None]
    assert one(spark, S.first_quoted(x), 'say "this" or', "none") == ["this", None]
    assert one(spark, S.loose_json(x), 'so: {"a": {}} ok', "none") == ['{"a": {}}', None]
    assert one(spark, S.replaced(x, "a.b", "$1"), "a.b axb") == ["$1 axb"]


def test_lines(spark):
    assert one(spark, S.estimated_lines(F.col("x"), 24.0), "a" * 51, "a" * 52, "", "a\nb") == [1, 2, 1, 2]


def test_likeness(spark):
    rows = spark.createDataFrame([("A b c", "a B d"), ("", ""), ("a", "")], "a string, b string")
    assert [r[0] for r in rows.select(S.jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 0.0]


def test_nearest_colour(spark):
    far = lambda a, b: sum((int(a[i : i + 2], 16) - int(b[i : i + 2], 16)) ** 2 for i in (0, 2, 4))
    some = ["FFFFFF", "123456", "00FF00", "FAFAFA", "7F7F7F"]
    want = [min((far(c, p), i, p) for i, p in enumerate(PALETTE)) for c in some]
    assert [tuple(x) for x in one(spark, S.nearest_colour(F.col("x")), *some)] == want
    assert one(spark, S.on_palette(F.col("x")), None, "FEFEFE", "123456") == [True, True, False]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab .!?,", max_size=90), min_size=1, max_size=6), st.integers(20, 60))
def test_shortened_fits(spark, texts, most):
    for x in one(spark, S.shortened(F.col("x"), F.lit(most)), *texts):
        assert len(x) <= most and not x.endswith((".", ",", ";"))


def test_decimals_make_code_that_the_jvm_compiles(spark):
    """Methods over 8,000 bytes are never compiled, only interpreted."""
    rows = spark.range(10).select(F.col("id").cast("double").alias("x")).select(S.fixed(F.col("x") / 7), S.fixed(F.col("x") * 1e6 / 3))
    tool = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    codes = tool.codegenStringSeq(rows._jdf.queryExecution().executedPlan())
    assert codes.size() and max(codes.apply(i)._3().maxMethodCodeSize() for i in range(codes.size())) < 8_000
