"""Findings of round 3 on disk: shuffle files of finished steps are deleted."""
import os
import time

from quillon.llm import linededup as LD


def _shuffles(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n.split("_")[1] for n in names if n.startswith("shuffle_")}


def test_line_dedup_lets_its_shuffles_go(spark, monkeypatch):
    """When classes are made of the verified pairs, the shuffle files of the steps
    before are gone but for the last one's, as each step is stored."""
    text = "\n".join(f"the quick brown fox number {i // 3} jumps over {'a' * (i % 3)} lazy dogs" for i in range(60))
    docs = spark.createDataFrame([(d, f"{text}\nonly in {d} and nowhere else at all") for d in range(20)], "doc_id long, text string")
    left, real, before = [], LD.components, _shuffles(spark)
    # The collector may run by itself, so the step must have asked for it.
    asked, let_go = [], LD.let_go
    monkeypatch.setattr(LD, "let_go", lambda s: asked.append(s) or let_go(s))

    def waiting(edges):
        for _ in range(100):
            if len(now := _shuffles(spark) - before) <= 2:
                break
            time.sleep(0.1)
        left.append(now)
        return real(edges)

    monkeypatch.setattr(LD, "components", waiting)
    rows = LD.line_report(docs).collect()
    assert len(left[0]) <= 2 and len(asked) >= 4
    assert sum(r["n_removed"] for r in rows) > 0 and len(rows) == 20
