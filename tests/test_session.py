"""Scratch folders."""

import os

from metricspark import session


def test_intermediates_are_dropped_on_request(spark, monkeypatch):
    monkeypatch.setattr(session, "_SCRATCH", {})
    monkeypatch.setattr(session, "CACHES", [remembered := {"a": 1}])
    df = session.stored(spark.range(5), "t-drop")
    path = session._SCRATCH[spark.sparkContext.applicationId][0].removeprefix("file:")
    assert df.count() == 5 and os.path.isdir(path)
    session.scratch_path(spark, "t-never-written")
    assert session.drop_intermediates(spark) == 1 and not os.path.exists(path)
    assert session.drop_intermediates(spark) == 0 and not remembered


def test_a_shared_folder_is_needed_off_local_mode(monkeypatch):
    class Context:
        def __init__(self, master):
            self.master, self.dir = master, None

        def getCheckpointDir(self):
            return None

        def setCheckpointDir(self, path):
            self.dir = path

    class Session:
        def __init__(self, master):
            self.sparkContext = Context(master)
            self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: None)})

    assert session.scratch_root(Session("local")) and session.scratch_root(Session("local[4]"))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        try:
            session.scratch_root(Session(master))
        except RuntimeError:
            continue
        raise AssertionError(master)
