"""The shared folder: configured on a cluster, temporary only for a local session."""

import pytest

from terralag import session as ses


class FakeContext:
    def __init__(self, master, directory=None):
        self.master, self.directory = master, directory

    def getCheckpointDir(self):
        return self.directory

    def setCheckpointDir(self, directory):
        self.directory = directory


class FakeSession:
    def __init__(self, master, configured=None):
        self.sparkContext = FakeContext(master)
        self.conf = self
        self.configured = configured

    def get(self, key, default=None):
        assert key == "spark.checkpoint.dir"
        return self.configured or default


def test_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError):
        ses.shared_dir(FakeSession("spark://host:7077"))


def test_configured_folder_is_used():
    fake = FakeSession("spark://host:7077", "hdfs:///shared")
    assert ses.shared_dir(fake) == "hdfs:///shared"
    assert fake.sparkContext.directory == "hdfs:///shared"
    assert ses.new_path(fake, "stage").startswith("hdfs:///shared/stage-")


def test_local_fallback_is_kept():
    fake = FakeSession("local[2]")
    assert ses.shared_dir(fake) == ses.shared_dir(fake)


def test_cut_lineage_keeps_rows(spark):
    df = spark.range(10).selectExpr("id", "id * 2 AS v")
    assert ses.cut_lineage(df).orderBy("id").collect() == df.orderBy("id").collect()


def test_stages_are_dropped(spark, monkeypatch):
    monkeypatch.setattr(ses, "_staged", [])
    path = ses.new_path(spark, "stage")
    spark.range(3).write.parquet(path)
    assert ses.drop_stages(spark) == 1 and ses.drop_stages(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
