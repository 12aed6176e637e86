from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from strandline import scratch


class _Setting:
    def __init__(self, value):
        self.value = value

    def isDefined(self):  # noqa: N802
        return self.value is not None

    def get(self):
        return self.value


def _session(master, setting=None, given=None):
    sc = SimpleNamespace(getCheckpointDir=lambda: _Setting(given))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: setting), sparkContext=SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: sc)))


def test_a_cluster_must_name_a_shared_folder():
    with pytest.raises(RuntimeError):
        scratch.shared_root(_session("spark://somewhere:7077"))
    with pytest.raises(RuntimeError):
        scratch.shared_root(_session("local-cluster[3,2,1024]"))
    assert scratch.shared_root(_session("yarn", "file:///shared/")) == "file:///shared"
    assert scratch.shared_root(_session("yarn", None, "file:///given")) == "file:///given"
    assert scratch.shared_root(_session("local[2]")).startswith("file:/")


def test_measures_are_taken_while_writing(spark):
    out = scratch.Scratch(spark, "test").table(spark.range(10), n=F.count(F.lit(1)), most=F.max("id"))
    assert out.measured == {"n": 10, "most": 9} and out.count() == 10
