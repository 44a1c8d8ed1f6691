"""The driver's entry holds without the training-data operators."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("absent", ["xxhash", "tiktoken", "regex", "zstandard", "public_tokenizers", "tidemark.llm"])
def test_entry_without_a_library(absent):
    code = f"import sys; sys.modules[{absent!r}] = None\nimport __spark_entry__ as e\nprint(len(e.queries()), len(e.oracle_sql()), 'weekly_rollup' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= 38 and int(out[1]) >= 36 and out[2] == "True"


def test_a_slip_in_the_subpackage_is_an_error():
    code = "import sys, importlib.abc\n"
    code += "class Slip(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, *a):\n        if name == 'tidemark.llm': raise ModuleNotFoundError(name='tidemark.slip')\nsys.meta_path.insert(0, Slip())\nimport __spark_entry__"
    if (ROOT / "tidemark/llm").is_dir():
        out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
        assert out.returncode and "ModuleNotFoundError" in out.stderr
