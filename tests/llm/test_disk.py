"""What stays on disk: shuffle files of finished steps, copies of members of large families."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import similar

ROOT = Path(__file__).parents[2]
STEPS = """
import sys, time
from pathlib import Path
from pyspark.sql import SparkSession
from ledgerloom.llm.linededup import fuzzy_line_dedup, normal_lines

own = Path(sys.argv[1])
conf = {"spark.ui.enabled": "false", "spark.driver.memory": "1g", "spark.sql.shuffle.partitions": "4", "spark.cleaner.referenceTracking": "false", "spark.checkpoint.dir": f"{own}/shared"}
builder = SparkSession.builder.master("local[2]")
for k, v in conf.items():
    builder = builder.config(k, v)
spark = builder.getOrCreate()
docs = spark.read.parquet(sys.argv[2]).select("doc_id", "text")
before = spark.conf.getAll
done = fuzzy_line_dedup(docs)
assert {k: v for k, v in spark.conf.getAll.items() if "leanup" in k} == {k: v for k, v in before.items() if "leanup" in k}
lines = {x for r in docs.collect() if r.text for x in normal_lines(r.text.encode()) if x}
for _ in range(40):  # files are removed beside what runs
    left = sum(p.stat().st_size for p in own.rglob("shuffle_*.data") if p.exists())
    if left < 100 * len(lines):
        break
    time.sleep(0.25)
print("left", left, len(lines), done.count())
"""


def test_finished_steps_leave_no_shuffle_files(tmp_path, sf_dir):
    """A driver that never collects its garbage: what the bands shuffled (320 bytes a line) is gone before the last step runs."""
    env = os.environ | {"SPARK_LOCAL_DIRS": str(tmp_path / "local"), "PYTHONPATH": str(ROOT)}
    run = subprocess.run([sys.executable, "-c", STEPS, str(tmp_path), f"{sf_dir}/documents.parquet"], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "left" in run.stdout, run.stderr[-2000:]
    left, lines, rows = map(int, run.stdout.split("left")[1].split())
    assert rows and left < 100 * lines


def test_members_of_a_large_family_are_copied_a_few_times(spark, monkeypatch):
    """3,000 sets, of which a few pairs are linked: none goes to more than some seventeen pairs of blocks, and all links are found."""
    rng = np.random.default_rng(7)
    sets = [np.sort(rng.choice(1 << 40, 20, replace=False).astype(np.uint64)) for _ in range(3000)]
    for i in range(0, 300, 3):
        sets[i + 1500] = np.sort(np.append(sets[i][1:], np.uint64(1 << 41)))
    rows = [(1, i, x.tobytes(), 3000) for i, x in enumerate(sets)]
    members = spark.createDataFrame(rows, "family long, node long, data binary, size long").repartition(4)
    copies, compare = [], similar.compared

    def counted(dealt, *args):
        copies.append(dealt.groupBy("node").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0)
        return compare(dealt, *args)

    monkeypatch.setattr(similar, "compared", counted)
    found = similar.verified_links(members, 80).collect()
    assert {(min(r), max(r)) for r in found} == {(i, i + 1500) for i in range(0, 300, 3)}
    assert copies[-1] <= similar.BLOCKS + 2
