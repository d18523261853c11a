import pytest

from leafwright.llm import common


def test_remembered_results_are_bounded():
    made = []
    known = common.Known(lambda w: made.append(w) or w.upper(), 4000)
    for k in range(2000):
        assert known[f"w{k}"] == f"W{k}" and known["often"] == "OFTEN"
    assert len(known) + len(known.old) < 80 and made.count("often") == 1
    long = "x" * 100
    assert known[long] == known[long] and made.count(long) == 2


def test_no_shared_folder_is_an_error():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError):
        common.shared_dir(Session())


def test_discarded_tables_are_gone(spark):
    table = common.settled(spark.range(5).toDF("a"), "some")
    assert table.count() == 5
    common.discard(table)
    with pytest.raises(Exception, match="(?i)path|not.exist|no such"):
        spark.read.parquet(table.settled_at).count()
