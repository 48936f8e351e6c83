"""The entry point with and without the folders that may be absent."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from pressline import catalog

ROOT = os.path.dirname(os.path.abspath(entry.__file__))
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


def copy_without(tmp_path, *absent):
    """A copy of the code in which only the caches of the absent folders may be left."""
    shutil.copytree(os.path.join(ROOT, "pressline"), tmp_path / "pressline", ignore=shutil.ignore_patterns("__pycache__", *absent))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in absent and os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path / name)
    return tmp_path


def imported(folder):
    return subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("absent", [("llm",), ("llm", "corpus_pipeline.py")])
def test_the_library_stands_alone(tmp_path, absent):
    folder = copy_without(tmp_path, *absent)
    if absent == ("llm",):
        (folder / "pressline" / "llm" / "__pycache__").mkdir(parents=True)
    run = imported(folder)
    assert run.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.SQL)), "False"], run.stderr


def test_a_fault_inside_an_optional_module_is_raised(tmp_path):
    folder = copy_without(tmp_path)
    if not (folder / "pressline" / "llm").exists():
        pytest.skip("nothing optional is here")
    (folder / "pressline" / "llm" / "queries.py").write_text("import pressline.llm.no_such_module")
    run = imported(folder)
    assert run.returncode != 0 and "no_such_module" in run.stderr
