import os

import pytest

from variform import session


class Fake:
    """Just what the lookup of the staging folder reads of a session."""

    def __init__(self, folder, master="local[2]"):
        self.conf = {session.CHECKPOINT_DIR: folder}
        self.sparkContext = self
        self.master = master

    def getConf(self):
        return self.conf


def test_the_shared_folder_is_used():
    assert session.staging_root(Fake("hdfs://shared/folder", "spark://somewhere")) == "hdfs://shared/folder"


def test_a_temporary_folder_only_on_one_machine():
    root = session.staging_root(Fake(None))
    assert os.path.isdir(root) and session.staging_root(Fake("")) == root
    with pytest.raises(ValueError, match=session.CHECKPOINT_DIR):
        session.staging_root(Fake(None, "yarn"))


def test_staged_tables_keep_their_schema_and_rows(spark):
    df = spark.createDataFrame([(1, [1.0, None]), (2, None)], "id int, x array<double>")
    back = session.stage(df)
    assert back.dtypes == df.dtypes and back.exceptAll(df).isEmpty() and back.count() == 2
