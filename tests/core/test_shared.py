"""The shared folder where the cluster names none: nothing that a running session refuses is set."""

from types import SimpleNamespace

from lexmill.sources.shared import shared_dir


class Conf(dict):
    def set(self, key, value):
        assert key != "spark.checkpoint.dir"
        self[key] = value


def test_own_folder():
    told = []
    context = SimpleNamespace(getCheckpointDir=lambda: told[0] if told else None, setCheckpointDir=told.append)
    spark = SimpleNamespace(conf=Conf(), sparkContext=context)
    found = shared_dir(spark)
    assert found.startswith("file:///") and shared_dir(spark) == found and told in ([], [found])
    spark.conf["spark.checkpoint.dir"] = "file:///mnt/shared"
    assert shared_dir(spark) == "file:///mnt/shared"
