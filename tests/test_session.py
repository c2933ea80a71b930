from types import SimpleNamespace

import pytest

from wikiloom.session import checkpoint_root, ship_package


def session(master, folder=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: folder, setCheckpointDir=lambda path: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="checkpoint"):
        checkpoint_root(session(master))
    assert checkpoint_root(session(master, "s3://bucket/x")) == "s3://bucket/x"


def test_local_sessions_make_one():
    assert checkpoint_root(session("local[4]")).startswith("/tmp/run-")


def test_workers_get_the_package(spark):
    ship_package(spark)
    assert sum(f.endswith("/wikiloom.zip") for f in spark.sparkContext.listFiles) == 1
