"""Line deduplication by default reaches the levels of its store."""

from __future__ import annotations

from corpusloom.llm import line_dedup


def test_default_batches_are_compacted_and_meet_two_levels(spark, monkeypatch):
    met = []
    add = line_dedup.LineStore.add

    def noted(self, run, rows):
        met.append([len(level) for level in self.levels])
        return add(self, run, rows)

    monkeypatch.setattr(line_dedup.LineStore, "add", noted)
    line = "a line of more than twenty characters"
    docs = spark.createDataFrame([(i, f"{line}\nown line of the document {i:03d}") for i in range(40)], "doc_id long, text string")
    out = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect()}
    assert out == {i: (f"own line of the document {i:03d}", 2, 1) if i < 39 else (f"{line}\nown line of the document 039", 2, 0) for i in range(40)}
    assert any(len(levels) > 1 and levels[0] and levels[1] for levels in met)
