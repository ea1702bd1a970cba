"""Published sets appear whole, versions are written once, and latest moves only when told to."""

import os

import pytest
from pyspark.sql import functions as F

from tradewright.sources import publish as pb


def tables(spark, n):
    return {"roster": spark.range(n).withColumn("v", F.lit(n)), "exclusions": spark.range(2 * n).withColumn("v", F.lit(n))}


def seen(spark, root, version=None):
    return {name: (t.count(), t.first()["v"]) for name, t in pb.read(spark, root, version).items()}


def test_a_broken_run_leaves_the_old_set(spark, tmp_path):
    root = str(tmp_path / "report")
    pb.publish(spark, tables(spark, 1), root, "2026-09-01")
    assert pb.latest(spark, root) is None
    pb.promote(spark, root, "2026-09-01")
    broken = {"roster": spark.range(9).withColumn("v", F.lit(9)), "exclusions": spark.range(9).withColumn("v", F.raise_error(F.lit("stopped")).cast("int"))}
    with pytest.raises(Exception, match="stopped"):
        pb.publish(spark, broken, root, "2026-09-02")  # the first table is written, the second is not
    assert os.listdir(f"{root}/tables/roster") and len(os.listdir(f"{root}/tables/roster")) == 2
    assert seen(spark, root) == {"roster": (1, 1), "exclusions": (2, 1)} and pb.versions(spark, root) == ["2026-09-01"]
    with pytest.raises(LookupError):
        pb.promote(spark, root, "2026-09-02")
    pb.publish(spark, tables(spark, 3), root, "2026-09-02")  # run again
    assert seen(spark, root) == {"roster": (1, 1), "exclusions": (2, 1)}  # published, not yet latest
    assert seen(spark, root, "2026-09-02") == {"roster": (3, 3), "exclusions": (6, 3)}
    pb.promote(spark, root, "2026-09-02")
    assert seen(spark, root)["roster"] == (3, 3)
    pb.promote(spark, root, "2026-09-01")  # and back
    assert seen(spark, root)["roster"] == (1, 1)


def test_a_version_is_published_once(spark, tmp_path):
    root = str(tmp_path / "report")
    pb.publish(spark, tables(spark, 1), root, "v")
    with pytest.raises(FileExistsError):
        pb.publish(spark, tables(spark, 2), root, "v")
    assert seen(spark, root, "v")["roster"] == (1, 1)
    with pytest.raises(LookupError):
        pb.read(spark, root)
