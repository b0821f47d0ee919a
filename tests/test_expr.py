"""Expressions of the usage model."""

from decimal import Decimal

from pyspark.sql import functions as F

from tallyforge.functions import expr


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


def test_project_identity(spark):
    cases = {"/a/b": "/a/b", "/a/.claude/worktrees/x/y": "/a", "C:\\p\\.claude\\worktrees": "C:\\p", "/.claude/worktrees": "", "/a/.claude/worktreesX": "/a/.claude/worktreesX"}
    for path, project in cases.items():
        assert one(spark, expr.project_identity("p"), p=path) == project


def test_model_key(spark):
    cases = {"Vendor/Model-X-20240131": "model-x", "m-2024-01-31": "m", "A [1m]": "a", "plain": "plain", "-2024-01-31": "-2024-01-31"}
    for model, key in cases.items():
        assert one(spark, expr.model_key("m"), m=model) == key


def test_prefixes_get_shorter(spark):
    assert one(spark, expr.prefixes(F.col("k")), k="a-b-c") == ["a-b-c", "a-b", "a"]


def test_hit_rate_leaves_output_out(spark):
    assert one(spark, expr.hit_rate(F.col("r"), F.col("i"), F.col("c")), r=3, i=4, c=5) == 0.25
    assert one(spark, expr.hit_rate(F.col("r"), F.col("i"), F.col("c")), r=0, i=0, c=0) == 0.0


def test_truncation_counts_characters(spark):
    assert one(spark, expr.truncated(F.col("t"), 4), t="éééé") == "éééé"
    assert one(spark, expr.truncated(F.col("t"), 4), t="ééééé") == "ééé…"


def test_day_of_unreadable_text(spark):
    assert one(spark, expr.utc_day(F.col("t")), t="2024-02-03T04:05:06Z") == "2024-02-03"
    assert one(spark, expr.utc_day(F.col("t")), t="not a timestamp") == "not a time"
    assert one(spark, expr.utc_day(F.col("t")), t="x") == "0000-00-00"


def test_cost_is_exact(spark):
    assert one(spark, expr.cost(F.col("r").cast("decimal(16,10)"), F.col("n")), r="0.1", n=3) == Decimal("0.0000003")
