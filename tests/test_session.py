"""Stage tables need a folder that all executors share."""

import pytest

from tradewright import session


class Named:
    def __init__(self, master, folder=None):
        self.master, self.folder, self.conf, self.sparkContext = master, folder, self, self

    def get(self, key, default=None):
        return self.folder

    def getCheckpointDir(self):
        return None


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,1024]"])
def test_a_cluster_must_name_the_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.stage_dir(Named(master))
    assert session.stage_dir(Named(master, "hdfs://x/y")) == "hdfs://x/y"


def test_local_mode_makes_its_own(spark):
    assert session.stage_dir(spark)
