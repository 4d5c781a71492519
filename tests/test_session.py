import types

import pytest

from sarmotion import session
from sarmotion.errors import ArgumentError


def context(master):
    made = types.SimpleNamespace(master=master, folder=None)
    made.getCheckpointDir = lambda: made.folder
    made.setCheckpointDir = lambda path: setattr(made, "folder", path)
    return made


def fake(master, configured=""):
    conf = types.SimpleNamespace(get=lambda key, default="": configured or default)
    return types.SimpleNamespace(sparkContext=context(master), conf=conf)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(ArgumentError):
        session.checkpoint_dir(fake(master))
    assert session.checkpoint_dir(fake(master, "hdfs:///work")) == "hdfs:///work"


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_one_process_may_use_a_folder_of_its_own(master):
    assert "sarmotion-checkpoint-" in session.checkpoint_dir(fake(master))
