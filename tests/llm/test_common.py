import threading

import pytest

from slabscan.llm.common import bound_batches, scratch, shared_dir, stored


def exists(spark, path):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def test_scopes_of_two_threads(spark):
    """A scope deletes the tables of its own thread only, and keeps what it was told to."""
    inside, checked, tables = threading.Barrier(2), threading.Barrier(2), {}

    def slow():
        with scratch(spark) as keep:
            a, b = stored(spark.range(3)), stored(spark.range(4))
            tables["slow"] = (a._stored_at, b._stored_at)
            inside.wait(60)
            checked.wait(60)
            keep(b)

    def fast():
        with scratch(spark) as keep:
            a, b = stored(spark.range(3)), stored(spark.range(4))
            tables["fast"] = (a._stored_at, b._stored_at)
            inside.wait(60)
            keep(b)
        tables["open"] = [exists(spark, p) for p in tables["slow"]]
        checked.wait(60)

    threads = [threading.Thread(target=f) for f in (slow, fast)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert tables["open"] == [True, True]
    for name in ("slow", "fast"):
        assert [exists(spark, p) for p in tables[name]] == [False, True]


def test_nested_scopes(spark):
    with scratch(spark) as keep:
        with scratch(spark) as keep_inner:
            a = stored(spark.range(2))
            keep_inner(a)
        b = stored(spark.range(5))
        assert a.count() == 2
        keep(b)
    assert not exists(spark, a._stored_at) and b.count() == 5


def test_batches_are_bounded_once(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for given, want in (("64m", str(16 << 20)), ("1048576", "1048576"), ("8mb", "8mb")):
            spark.conf.set(name, given)
            bound_batches(spark)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)


def test_no_shared_folder():
    """A session of several machines must name the shared folder."""

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master, applicationId = "spark://x:7077", "a"

    with pytest.raises(ValueError):
        shared_dir(Session())
