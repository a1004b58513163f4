"""The shared folder: one on a cluster, gone with the session, tables dropped when over."""

import glob
import os

import pytest

from docmill.sources import shared


class Context:
    applicationId, master = "app-on-a-cluster", "spark://host:7077"


class Session:
    sparkContext = Context()
    conf = {}


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    monkeypatch.setattr(Session, "conf", {"spark.checkpoint.dir": None})
    with pytest.raises(RuntimeError):
        shared.shared_root(Session())


def test_tables_are_dropped(spark):
    df = shared.materialise(spark.range(5), "some")
    root = shared.shared_root(spark).removeprefix("file://")
    assert df.count() == 5 and glob.glob(f"{root}/some-*")
    shared.discard(df)
    assert os.path.isdir(root) and not [x for x in glob.glob(f"{root}/some-*") if os.listdir(x)]
