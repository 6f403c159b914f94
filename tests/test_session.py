"""The checkpoint folder: the cluster's shared setting, a scratch folder only in local mode."""

import types

import pytest

from sellerlens.session import checkpoint_dir


def _session(master: str, configured: str | None):
    state = {"dir": None}
    conf = types.SimpleNamespace(get=lambda key, default=None: configured if key == "spark.checkpoint.dir" else default)

    def set_dir(d):
        state["dir"] = d

    sc = types.SimpleNamespace(master=master, getCheckpointDir=lambda: state["dir"], getConf=lambda: conf,
                               setCheckpointDir=set_dir)
    return types.SimpleNamespace(sparkContext=sc)


def test_cluster_uses_the_configured_shared_folder():
    assert checkpoint_dir(_session("yarn", "hdfs://shared/ckpt")) == "hdfs://shared/ckpt"


def test_cluster_without_setting_fails_instead_of_using_a_local_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(_session("spark://master:7077", None))


def test_local_mode_without_setting_gets_a_scratch_folder():
    assert checkpoint_dir(_session("local[4]", None))
