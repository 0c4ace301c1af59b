import os

import pytest

from loam.llm import common


def test_stash_and_release(spark):
    a, b = common.stash(spark.range(5), "a"), common.stash(spark.range(6), "b")
    assert (a.count(), b.count()) == (5, 6)
    common.release(b)
    assert not os.path.exists(a.stash_path.removeprefix("file://")) and b.count() == 6
    common.discard(b)
    assert not common._STASHED


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())
    Session.sparkContext.master = "local[2]"
    assert common.shared_dir(Session()).startswith("file://")


def test_fresh_names(spark):
    assert common.fresh(spark.range(1).selectExpr("id AS Score", "id AS _score"), "score") == "__score"


def test_scopes_delete_their_own_tables_only(spark):
    before = common.stash(spark.range(3), "before")
    with common.scope() as own:
        a = common.stash(spark.range(5), "a")
        with common.scope() as inner:
            b = common.stash(spark.range(6), "b")
        c = common.stash(spark.range(7), "c")
    own.release(c)
    assert (before.count(), b.count(), c.count()) == (3, 6, 7) and not os.path.exists(a.stash_path.removeprefix("file://"))
    inner.release()
    common.discard(before, c)
    assert not {x.stash_path for x in (a, b, c, before)} & common._STASHED.keys()


def test_attach_whatever_share_a_key_has(spark):
    rows = common.stash(spark.range(400).selectExpr("if(id < 300, 7, id) AS k", "id"), "rows")
    table = common.stash(rows.filter("id % 3 = 0").groupBy("k").count(), "table")
    n = common.stash(rows.groupBy("k").count().join(table.select("k"), "k", "left_semi"), "n")
    want = sorted(map(tuple, rows.join(n, "k").collect()))
    for least in (1, 1000):
        assert sorted(map(tuple, common.attach(rows, n, ["k"], "count", 400, least).collect())) == want
    common.discard(rows, table, n)
