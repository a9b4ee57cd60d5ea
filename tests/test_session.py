import pytest

from lineweave import session


def test_named_folder_wins(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "checkpoint_root", lambda _, named=session.checkpoint_root: named(_Named(spark, str(tmp_path))))
    out = session.cut(spark.range(3))
    assert out.count() == 3 and out.inputFiles()[0].startswith(f"file://{tmp_path}/{spark.sparkContext.applicationId}/")


class _Named:
    """A session whose settings name the shared folder; the real one is fixed at start."""

    def __init__(self, spark, folder):
        self.sparkContext, self._folder = spark.sparkContext, folder
        self.conf = self

    def get(self, key, default=None):
        return self._folder + "/" if key == "spark.checkpoint.dir" else default


def test_a_cluster_must_name_its_folder():
    class Conf(dict):
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Fake:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Fake())
