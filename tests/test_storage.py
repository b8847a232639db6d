"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from tidewatch.sources.storage import materialize, shared_folder


def session(master, **settings):
    kept = dict(settings)
    conf = SimpleNamespace(get=lambda k, d=None: kept.get(k, d), set=kept.__setitem__)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))


def test_folder_is_the_clusters_or_made_for_one_machine():
    assert shared_folder(session("spark://x:7077", **{"spark.checkpoint.dir": "hdfs://a/b/"})) == "hdfs://a/b"
    one = session("local[4]")
    assert shared_folder(one).startswith("file://") and shared_folder(one) == shared_folder(one)
    for master in ("spark://x:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            shared_folder(session(master))


def test_a_table_is_written_once(spark):
    rows = spark.range(10).selectExpr("id", "cast(rand() as double) x", "array(id) a")
    kept = materialize(rows, "some")
    assert sorted(kept.collect()) == sorted(kept.collect()) and kept.schema == rows.schema.__class__(kept.schema.fields)
