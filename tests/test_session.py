"""Where lineage cuts go."""

import pytest

from newsloom.session import scratch_path, settle, shared_dir


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, master, named=None):
        self.sparkContext, self.conf = Context(master), {"spark.checkpoint.dir": named} if named else {}


def test_named_folder_is_used():
    assert shared_dir(Session("spark://x:7077", "/shared/cuts")) == "/shared/cuts"


def test_cluster_without_folder_is_refused():
    with pytest.raises(RuntimeError):
        shared_dir(Session("spark://x:7077"))


def test_local_session_without_folder_gets_one():
    session = Session("local[2]")
    folder = shared_dir(session)
    assert folder == session.sparkContext.folder == shared_dir(session)


def test_settle_keeps_rows_and_forgets_the_plan(spark):
    rows = settle(spark.range(10).where("id > 3"))
    assert rows.count() == 6 and "Range" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
