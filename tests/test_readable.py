import pytest
from pyspark.sql import functions as F
from stagelens.functions import readable as R
from stagelens.render import node_color


@pytest.mark.parametrize(("value", "kind", "text"), [(0, "size", "0.0 B"), (1023, "size", "1023.0 B"), (1024, "size", "1.0 KiB"), (1024**2 - 1, "size", "1024.0 KiB"), (1024**2, "size", "1.0 MiB"), (1024**3, "size", "1.0 GiB"), (1024**4, "size", "1.0 TiB"), (999, "timing", "999.0 ms"), (1000, "timing", "1.0 s"), (59_999, "timing", "60.0 s"), (60_000, "timing", "1.0 min"), (3_599_999, "timing", "60.0 min"), (3_600_000, "timing", "1.0 hr"), (1536, "size", "1.5 KiB")])
def test_readable(spark, value, kind, text):
    row = spark.range(1).select(R.readable(F.lit(value), kind).alias("r")).first()
    assert row.r.readable_str == text


def test_null_and_other_kinds(spark):
    row = spark.range(1).select(R.readable(F.lit(None).cast("long"), "size").alias("a"), R.unit_of(F.lit("v2Custom")).alias("b"), R.order_of(F.lit("v2Custom")).alias("c"), R.count_text(F.lit(None).cast("long")).alias("d"), R.count_text(F.lit(1_500_000)).alias("e"), R.bytes_text(F.lit(1536)).alias("f")).first()
    assert tuple(row) == (None, "", 99, "unknown", "1.5M", "1.5 KiB")


def test_paths(spark):
    row = spark.range(1).select(R.path_name(F.lit("s3://b/c/d.tar.gz/")).alias("a"), R.path_stem(F.lit("/x/.hidden")).alias("b"), R.is_cloud_path(F.lit("/dbfs/x")).alias("c"), R.is_cloud_path(F.lit("s3://x")).alias("d")).first()
    assert tuple(row) == ("d.tar.gz", ".hidden", False, True)


def test_colours():
    assert node_color(None, 0, 1) == node_color(float("nan"), 0, 1) == node_color(0, 0, 1)
    assert node_color(0, 0, 1) != node_color(1, 0, 1)
    assert node_color(3, 3, 3) == node_color(0.5, 0, 1)
