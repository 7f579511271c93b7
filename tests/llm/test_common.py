"""The folder of intermediate tables."""

import pytest

from vintage_jobs.llm.common import shared_dir


class Session:
    """Stands in for a session: its settings are all that is read."""

    def __init__(self, **settings):
        self.settings = {k.replace("_", "."): v for k, v in settings.items()}
        self.conf = self

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def set(self, key, value):
        self.settings[key] = value


def test_shared_folder():
    assert shared_dir(Session(spark_master="spark://a:7077", spark_checkpoint_dir="s3a://b/c/")).rstrip("/") == "s3a://b/c"
    for master in ("local", "local[4]"):
        own = Session(spark_master=master)
        own.set("spark.sql.warehouse.dir", "file:/w")
        with pytest.warns(UserWarning, match="unset"):
            assert shared_dir(own) == "file:/w/_shared"
    for master in ("local-cluster[3,2,1024]", "spark://a:7077", "yarn", "k8s://a"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(Session(spark_master=master))
