"""The base library stands without the subpackage for training data and the pipeline file."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_without_the_training_data_folders(tmp_path):
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm", "*.json", "*.md")
    for pipeline in (True, False):
        home = tmp_path / str(pipeline)
        shutil.copytree(ROOT, home, ignore=skip)
        assert not (home / "vozlens" / "llm").exists() and not (home / "tests" / "llm").exists()
        if not pipeline:
            (home / "corpus_pipeline.py").unlink(missing_ok=True)
        said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and not [n for n in q if n.startswith('op') or n == 'pipeline']; print(len(q))"], cwd=home, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(home)})
        assert said.returncode == 0, said.stderr
        assert int(said.stdout) > 70
