from __future__ import annotations

import pytest

from tablepulse import session


def test_shuffles_follow_the_input_size(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert session.size_shuffles(spark, 0) == spark.sparkContext.defaultParallelism
        assert session.size_shuffles(spark, 100 << 40) == 409_600
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


class Cluster:
    """Just enough of a session to look like a cluster without a shared folder."""

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

    class conf:
        @staticmethod
        def get(key, default=None):
            return default


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError):
        session.shared_folder(Cluster)


def test_shared_folders_are_new(spark):
    assert session.shared_folder(spark) != session.shared_folder(spark)
