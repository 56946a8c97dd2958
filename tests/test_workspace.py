"""Where intermediate tables go."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from gatetally.workspace import shared_folder


def session(master: str, setting: str | None = None, directory: str | None = None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: {"spark.checkpoint.dir": setting}[key]),
        sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: directory),
    )


def test_folder_the_session_names(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_folder(spark, "reports"), shared_folder(spark, "reports")
    assert first.startswith(f"{root}/reports-")
    assert first != second


def test_setting_comes_before_the_context():
    both = session("yarn", "hdfs:///setting/", "hdfs:///context")
    assert shared_folder(both, "x").startswith("hdfs:///setting/x-")
    assert shared_folder(session("yarn", None, "hdfs:///c"), "x").startswith("hdfs:///c/x-")


def test_no_local_folder_on_a_cluster():
    assert shared_folder(session("local[8]"), "x")
    for master in ("yarn", "spark://host:7077", "k8s://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(master), "x")
