import os
import subprocess
import sys
from types import SimpleNamespace

from pricetide import session
from pricetide.session import materialize, release

SCRIPT = """
from pricetide.session import build_session, materialize, release
spark = build_session("no folder", "local[2]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"})
assert spark.conf.get("spark.checkpoint.dir", None) is None
stored = materialize(spark.range(10).repartition(3))
assert stored.count() == 10 and stored.is_cached
release(spark)
assert not stored.is_cached
"""


def test_stored_tables_are_released(spark):
    folder = spark.conf.get("spark.checkpoint.dir") + "/pricetide"
    release(spark)
    stored = materialize(spark.range(10))
    assert stored.count() == 10 and len(os.listdir(folder)) == 1
    release(spark)
    assert os.listdir(folder) == []


def test_single_tables_are_released(spark):
    folder = spark.conf.get("spark.checkpoint.dir") + "/pricetide"
    release(spark)
    first, second = materialize(spark.range(10).repartition(2, "id")), materialize(spark.range(5))
    release(spark, first)
    assert len(os.listdir(folder)) == 1 and second.count() == 5
    release(spark)
    assert os.listdir(folder) == []


def test_tables_without_a_shared_folder(tmp_path):
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path)}
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=root, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_storing_a_table_trims_a_grown_driver_heap(spark, monkeypatch):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    monkeypatch.setattr(session, "_apart", lambda spark: True, raising=False)
    counts = []
    for share in (0, 1.1):
        monkeypatch.setattr(session, "HEAP_SHARE", share, raising=False)
        before = full()
        assert materialize(spark.range(10)).count() == 10
        counts.append(full() - before)
    release(spark)
    assert counts[0] >= 1 and counts[1] == 0


def test_only_executors_of_their_own_leave_the_driver_to_be_trimmed():
    context = lambda master: SimpleNamespace(sparkContext=SimpleNamespace(master=master))
    assert [session._apart(context(m)) for m in ("local", "local[4]", "local-cluster[3,2,3000]", "yarn", "spark://a:7077")] == [
        False, False, True, True, True]
