import subprocess
import sys

import __spark_entry__ as entry


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_training_data_part(tmp_path):
    """The registry must work where the llm folders and the pipeline are not there."""
    import pathlib
    import shutil

    root = pathlib.Path(entry.__file__).parent
    shutil.copytree(root / "factloom", tmp_path / "factloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    n, pipeline, covered = said.stdout.split()
    assert int(n) > 40 and pipeline == "False" and covered == "True"
