"""The entry module without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_subpackage(tmp_path):
    for name in os.listdir(ROOT):
        if name.endswith(".py") or name in ("loomframe", "tests"):
            source = os.path.join(ROOT, name)
            if os.path.isdir(source):
                shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
            else:
                shutil.copy(source, tmp_path / name)
    script = "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and not [q for q in e.queries() if q.startswith('op')]; print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0 and int(done.stdout.split()[-1]) > 100, done.stderr
