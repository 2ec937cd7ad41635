"""The entry, with and without what the training-data queries need."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
BLOCKED = """
import sys, warnings
warnings.simplefilter("ignore")
class Blocker:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Blocker())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), *e.queries())
"""


def names(blocked):
    run = subprocess.run([sys.executable, "-c", BLOCKED.format(name=blocked)], cwd=ROOT, capture_output=True, text=True, check=True)
    return run.stdout.split()[2:]


@pytest.mark.parametrize("absent", ["millrace.llm", "ahocorasick", "sentencepiece"])
def test_core_queries_without_optional_parts(absent):
    from millrace.queries import QUERIES

    assert [n for n in names(absent) if not n.startswith("op") and n != "pipeline"] == list(QUERIES)


def test_without_the_pipeline():
    found = names("corpus_pipeline")
    assert "pipeline" not in found and "flagship" in found
