"""The entry lists its queries without a Spark session, as a tool that only reads their names does."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_names_need_no_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q))"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr[-800:]
    assert int(said.stdout) > 200


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_works_without_the_training_data_operators(tmp_path, pipeline_stays):
    """A copy of the library without its subpackage still lists and runs everything else."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT / "timedframe", copy / "timedframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py", *(["corpus_pipeline.py"] if pipeline_stays and (ROOT / "corpus_pipeline.py").exists() else [])):
        shutil.copy(ROOT / name, copy)
    code = (
        "import __spark_entry__ as e, bench; q = e.queries(); assert len(q) > 200 and 'pipeline' not in q and not any(n.startswith('op') for n in q), len(q)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "print(q['ag1_queue_depth'](s, '/root/testdata/sf0.001').count())"
    )
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True, timeout=240)
    assert said.returncode == 0, said.stderr[-800:]
    assert int(said.stdout) > 0
