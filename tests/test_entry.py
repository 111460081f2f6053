"""The entry points without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = """
import sys
import __spark_entry__ as entry
from assay.session import local_session
names = entry.queries()
assert not [n for n in names if n.startswith("op") or n == "pipeline"], names
assert "assay.llm" not in sys.modules
print(names["accuracy"](local_session("alone", 2, "1g"), sys.argv[1]).count())
"""


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_the_rest_works_without_the_subpackage(tmp_path, sf_dir, with_pipeline):
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if with_pipeline else ["corpus_pipeline.py"]))
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    done = subprocess.run([sys.executable, "-c", PROBE, sf_dir], cwd=copy, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split()[-1]) > 0
