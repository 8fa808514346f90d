import pytest

from wayfold import session


class Fake:
    """A session with a master and a setting; nothing else is asked of it."""

    def __init__(self, master, folder=None):
        self.conf = self
        self.sparkContext = self
        self.master, self.folder, self.applicationId = master, folder, f"fake-{master}"

    def get(self, name, default=None):
        return self.folder if name == "spark.checkpoint.dir" else default

    def getConf(self):
        return self


def test_the_shared_folder_is_the_sessions():
    assert session.shared_folder(Fake("spark://host", "hdfs://x/shared/")) == "hdfs://x/shared"
    assert session.shared_folder(Fake("local[2]", "file:///a")) == "file:///a"


def test_only_a_local_session_gets_a_temporary_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Fake("local-cluster[3,2,1000]".replace("local", "yarn")))
    assert "wayfold-" in session.shared_folder(Fake("local[2]"))


def test_local_cluster_is_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Fake("local-cluster[3,2,1000]"))


def test_scratch_tables(spark):
    s = session.Scratch(spark, "x")
    kept = s.keep(spark.range(3), "t")
    assert kept.count() == 3
    s.drop(kept)
    with pytest.raises(Exception):  # noqa: B017  the files are gone
        kept.count()
    empty = s.keep(spark.range(0), "t")
    assert empty.count() == 0 and empty.columns == ["id"]
