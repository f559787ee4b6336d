"""The driver gives back what fitting the classifier took."""

import re
import sys

import pytest

from scanweave.llm import common, toxicity


def resident_mb():
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", f.read()))) / 1024


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_freed_memory_goes_back():
    pieces = [b"x" * 600 + bytes(400) for _ in range(200_000)]
    pieces = pieces[::50]
    before = resident_mb()
    common.release_memory()
    assert before - resident_mb() > 100 and len(pieces) == 4000


def test_fitting_gives_back(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(toxicity, "release_memory", lambda: calls.append(1))
    docs = spark.createDataFrame([(1, "a word"), (2, None)], "doc_id BIGINT, text STRING")
    labels = spark.createDataFrame([(1, 0), (2, None)], "doc_id BIGINT, toxic INT")
    assert toxicity.fit(docs, labels).scale == 1.0 and calls == [1]
