"""Runs of line deduplication are compared where they lie, whatever the session's partitions."""

from __future__ import annotations

from pathlib import Path

import pytest

from corpusloom.llm import line_dedup


@pytest.fixture
def many_partitions(spark):
    conf = {
        "spark.sql.shuffle.partitions": "40",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {key: spark.conf.get(key) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def test_runs_meet_without_exchange(spark, monkeypatch, many_partitions):
    moved, files, save = [], [], line_dedup.LineStore._save

    def noted(self, run, *more, **named):
        plan = run._jdf.queryExecution().executedPlan().toString()
        if "Join" in plan:
            moved.append(plan.count("Exchange"))
        name = save(self, run, *more, **named)
        folder = Path(f"{self.folder}/{name}".removeprefix("file:"))
        files.append((len(list(folder.glob("part-*"))), self.buckets))
        return name

    monkeypatch.setattr(line_dedup.LineStore, "_save", noted)
    docs = spark.createDataFrame(
        [(i, "\n".join(f"line of the document, number {(i * k) % 97:03d}" for k in range(1, 9))) for i in range(300)],
        "doc_id long, text string",
    )
    assert line_dedup.dedup_lines(docs).count() == 300
    assert moved and not any(moved)
    assert all(n <= buckets for n, buckets in files)
