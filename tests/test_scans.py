"""Scans that are split over batches, fail, or never end, with restarts between batches."""

import json
from datetime import datetime, timedelta

import pytest

from siftline.streaming import scans

RULES = ["r1", "r2"]
START = datetime(2024, 1, 1)


class Feed:
    """Files of marks and findings, and runs of both streams over whatever is new."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, path, 0
        for d in ("marks", "findings"):
            (path / d).mkdir()

    def add(self, marks=(), findings=()):
        self.n += 1
        at = lambda minutes: (START + timedelta(minutes=minutes)).isoformat()
        rows = {
            "marks": [{"scan_id": s, "mark": m, "at": at(t), "error": e} for s, m, t, e in marks],
            "findings": [{"scan_id": s, "fingerprint": f, "rule_id": r, "file_path": p, "severity": "HIGH", "pos": i} for i, (s, f, r, p) in enumerate(findings)],
        }
        for name, some in rows.items():
            if some:
                (self.path / name / f"{self.n:03d}.json").write_text("\n".join(map(json.dumps, some)))

    def run(self, patience="1 hour"):
        read = lambda name, schema: self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(self.path / name))
        scans.stage(read("findings", scans.FINDING), str(self.path / "out"), str(self.path / "c1")).awaitTermination()
        rules = self.spark.createDataFrame([(r,) for r in RULES], "rule_id string")
        scans.close_scans(read("marks", "scan_id string, mark string, at timestamp, error string"), str(self.path / "out"), str(self.path / "c2"), rules, patience).awaitTermination()

    def status(self):
        return {r.fingerprint: r.status for r in scans.current(self.spark, str(self.path / "out")).collect()}

    def history(self):
        rows = scans.history(self.spark, str(self.path / "out")).orderBy("batch", "seq").collect()
        return [(r.scan_id, r.status, r.n_new, r.n_resolved, r.error) for r in rows]


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def test_a_scan_over_three_batches_closes_once(feed):
    feed.run()
    assert feed.status() == {} and feed.history() == []
    feed.add([("a", "START", 0, None), ("a", "END", 1, None)], [("a", "f1", "r1", "x"), ("a", "f2", "r1", "y"), ("a", "f3", "r2", "z")])
    feed.run()
    assert feed.status() == dict.fromkeys(("f1", "f2", "f3"), "OPEN") and feed.history() == [("a", "STARTED", None, None, None), ("a", "SUCCEEDED", 3, 0, None)]
    # The second scan finds f1 in its first batch, f4 in its second, and that z failed in its third; f2 is solved only when it ends.
    feed.add([("b", "START", 2, None)], [("b", "f1", "r1", "x")])
    feed.run()
    assert feed.status() == dict.fromkeys(("f1", "f2", "f3"), "OPEN")
    feed.add([], [("b", "f4", "r1", "x"), ("b", "f4", "r1", "x")])
    feed.run()
    feed.add([("b", "END", 3, None), ("b", "END", 4, None), ("b", "FAIL", 5, "late")], [("b", None, None, "z")])
    feed.run()
    assert feed.status() == {"f1": "OPEN", "f2": "RESOLVED", "f3": "OPEN", "f4": "OPEN"}
    assert feed.history()[2:] == [("b", "STARTED", None, None, None), ("b", "SUCCEEDED", 1, 1, None)]
    feed.run()
    assert len(feed.history()) == 4


def test_failed_and_lost_scans_change_nothing(feed):
    feed.add([("a", "START", 0, None), ("a", "END", 1, None)], [("a", "f1", "r1", "x")])
    feed.add([("b", "START", 2, None), ("b", "FAIL", 3, "analyzer died")], [("b", "f9", "r1", "x")])
    feed.add([("c", "START", 4, None)], [("c", "f8", "r1", "x")])
    # Much later another scan of nothing; by then the timer has failed c, whose END comes too late.
    feed.add([("d", "START", 300, None), ("d", "END", 301, None)])
    feed.run()
    feed.add([("c", "END", 302, None), ("e", "START", 303, None)])
    feed.run()
    told = feed.history()
    assert ("b", "FAILED", None, None, "analyzer died") in told and ("c", "FAILED", None, None, scans.TIMED_OUT) in told and ("d", "SUCCEEDED", 0, 1, None) in told
    assert feed.status() == {"f1": "RESOLVED"} and [t[1] for t in told if t[0] == "e"] == ["STARTED"]


def test_two_scans_that_end_in_one_batch_are_applied_in_order(feed):
    feed.add([("b", "START", 2, None), ("b", "END", 4, None), ("a", "END", 1, None)], [("a", "f1", "r1", "x"), ("b", "f2", "r1", "x")])
    feed.run()
    assert feed.status() == {"f1": "RESOLVED", "f2": "OPEN"}
    assert [(s, t) for s, t, *_ in feed.history()] == [("a", "STARTED"), ("a", "SUCCEEDED"), ("b", "STARTED"), ("b", "SUCCEEDED")]
