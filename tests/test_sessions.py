"""Scan sessions and the complete listing."""

import os

import pytest
from pyspark.sql import functions as F

from cairn import schemas
from cairn.operators import sessions
from cairn.sources.walk import list_tree
from cairn.streaming import discovery

T1, T2, T3 = "2025-01-01T00:00:00Z", "2025-01-02T00:00:00Z", "2025-01-03T00:00:00Z"
NAMES = ["a.csv", "z.csv", "b/c/d.csv", "b/a.csv", "b/z.csv", "a/x.csv"]
ORDER = ["a.csv", "z.csv", "a/x.csv", "b/a.csv", "b/z.csv", "b/c/d.csv"]


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], schemas.INVENTORY), spark.createDataFrame([], sessions.SESSIONS)


def listing(spark, names):
    return spark.createDataFrame([(n, len(n), 1) for n in names], schemas.LISTING)


def test_walk_order_lists_files_before_folders(spark):
    df = listing(spark, NAMES).orderBy(sessions.walk_order(F.col("relative_path")))
    assert [r["relative_path"] for r in df.collect()] == ORDER


def test_batches_resume_and_only_a_whole_pass_marks_missing(spark, empty):
    records, table = empty
    seen = []
    for call in range(3):
        got = sessions.scan_batch(records, table, listing(spark, NAMES), f"s{call}", T1, max_files=2)
        records, table = got.records, sessions.replaced(table, got.session)
        row = got.session.first()
        seen.append((row["session_id"], row["status"], row["files_seen"], row["files_new"], row["checkpoint_path"], got.remaining))
    assert seen == [
        ("s0", "active", 2, 2, "z.csv", 4), ("s0", "active", 4, 4, "b/a.csv", 2), ("s0", "completed", 6, 6, "b/c/d.csv", 0),
    ]
    # Second pass: a file is gone, but the first call must not report it.
    now = listing(spark, [n for n in NAMES if n != "a.csv"])
    first = sessions.scan_batch(records, table, now, "t", T2, max_files=3)
    assert first.records.where("inventory_status = 'missing'").count() == 0
    again = sessions.scan_batch(first.records, sessions.replaced(table, first.session), now, "u", T3)
    row = again.session.first()
    assert (row["session_id"], row["generation"], row["status"], row["files_seen"], row["files_unchanged"], row["files_marked_missing"]) == ("t", 2, "completed", 5, 5, 1)
    gone = again.records.where("inventory_status = 'missing'").first()
    assert (gone["relative_path"], gone["updated_utc"], gone["last_seen_generation"]) == ("a.csv", T3, 1)


def test_a_repeated_call_counts_nothing_twice(spark, empty):
    records, table = empty
    one = sessions.scan_batch(records, table, listing(spark, NAMES), "s", T1, max_files=4)
    table = sessions.replaced(table, one.session)
    done = sessions.scan_batch(one.records, table, listing(spark, NAMES), "s", T1)
    row = done.session.first()
    assert (row["files_seen"], row["files_new"], done.records.count()) == (6, 6, 6)


def test_problems_fail_the_session_and_mark_nothing(spark, empty):
    records, table = empty
    whole = sessions.scan_batch(records, table, listing(spark, NAMES), "s", T1)
    table = sessions.replaced(table, whole.session)
    bad = spark.createDataFrame([("b", "folder cannot be read")], "relative_path string, problem string")
    failed = sessions.scan_batch(whole.records, table, listing(spark, ["a.csv"]), "t", T2, problems=bad)
    row = failed.session.first()
    assert (row["status"], row["errors_count"], row["files_seen"], row["files_marked_missing"]) == ("failed", 1, 1, 0)
    assert failed.records.where("inventory_status = 'missing'").count() == 0
    with pytest.raises(ValueError, match="not active"):
        sessions.moved(failed.session, "completed", T2, failed.session)


def test_one_active_session_only(spark, empty):
    _, table = empty
    table = sessions.replaced(table, sessions.begin(table, "s", T1))
    with pytest.raises(ValueError, match="already exists"):
        sessions.begin(table, "t", T1)
    with pytest.raises(ValueError, match="max_files"):
        sessions.scan_batch(empty[0], table, listing(spark, NAMES), "s", T1, max_files=0)


def test_tree_keeps_empty_and_hidden_files_and_reports_links(spark, tmp_path):
    root = tmp_path / "tree"
    for name, size in {"empty.csv": 0, "_hidden.csv": 3, ".dot": 1, "in/_a/x y+%.csv": 5, "in/ü.csv": 2, "last/z": 0}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * size)
        os.utime(path, ns=(1, 1_700_000_000_123_456_789))
    (root / "in/link.csv").symlink_to(root / "empty.csv")
    (root / "other").symlink_to(root / "in")
    found, problems = list_tree(spark, str(root), slices=3)
    got = {r["relative_path"]: (r["size_bytes"], r["mtime_ns"]) for r in found.collect()}
    stamp = 1_700_000_000_123_456_789
    assert got == {
        "empty.csv": (0, stamp), "_hidden.csv": (3, stamp), ".dot": (1, stamp), "in/_a/x y+%.csv": (5, stamp), "in/ü.csv": (2, stamp), "last/z": (0, stamp),
    }
    assert found.count() == 6
    assert sorted(tuple(r) for r in problems.collect()) == [("in/link.csv", "link is not followed"), ("other", "link is not followed")]


def test_stream_compares_with_the_stored_records_and_replays_a_batch(spark, tmp_path, empty):
    root, out = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    for n in range(5):
        (root / f"f{n}.csv").write_text("x" * (n + 1))
    old = listing(spark, ["f0.csv", "gone.csv"])
    prior = sessions.scan_batch(*empty, old, "s", T1).records
    discovery.start_discovery(spark, str(root), out, str(tmp_path / "cp"), "t", 2, T2, 2, prior=prior).awaitTermination()
    counted = discovery.discovered_counters(spark, out, 2).first()
    assert (counted["files_seen"], counted["files_new"], counted["files_changed"], counted["batches"]) == (5, 4, 1, 3)
    # A replayed batch writes its own folder again.
    again = spark.read.schema(f"{schemas.INVENTORY}, outcome string").parquet(f"{out}/generation=2/batch=1")
    discovery.write_batch(again.select("relative_path", "size_bytes", "mtime_ns"), 1, out, "t", 2, T2, prior)
    assert discovery.discovered_counters(spark, out, 2).first() == counted
    open_ = discovery.finish(spark, prior, out, 2, T3, errors=1)
    assert open_.where("inventory_status = 'missing'").count() == 0
    done = discovery.finish(spark, prior, out, 2, T3, errors=0)
    assert [r["relative_path"] for r in done.where("inventory_status = 'missing'").collect()] == ["gone.csv"]
    assert done.count() == 6
