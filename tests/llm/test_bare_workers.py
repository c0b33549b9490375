"""Queries on workers that cannot import the package: only the driver knows its folder."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__
from tablework.session import build_session

spark = build_session("bare", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}})
spark.sparkContext.setLogLevel("ERROR")
for name in {names!r}:
    print(name, __spark_entry__.queries()[name](spark, {sf!r}).count())
"""


def test_workers_need_no_copy_of_the_package(sf, tmp_path):
    names = ["op1_toxicity", "op3_packing", "op5_lm_scoring", "op6_decontamination", "op11_spelling_variants", "op12_hard_negatives"]
    repo = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(repo=repo, names=names, sf=sf))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    found = dict(line.split() for line in done.stdout.splitlines() if line.startswith("op"))
    assert list(found) == names and int(found["op5_lm_scoring"]) == int(found["op1_toxicity"]) > 0


def test_the_tagger_travels_by_value():
    code = "import __spark_entry__; from pyspark import cloudpickle; from tablework.llm import personal; print(len(cloudpickle.dumps(personal.added_spans)))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
