"""The entry registers the claims queries whatever becomes of the optional subpackage."""

import subprocess
import sys

from tests.conftest import ROOT

BLOCK = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name in {names!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Block())
sys.path.insert(0, {root!r})
import __spark_entry__ as E
q, o = E.queries(), E.oracle_sql()
assert set(o) <= set(q), set(o) - set(q)
print(len(q), sum(k.startswith("op") and k[2].isdigit() for k in q), "pipeline" in q)
"""


def run(*names):
    out = subprocess.run([sys.executable, "-c", BLOCK.format(names=set(names), root=ROOT)], capture_output=True, text=True, check=True).stdout.split()
    return int(out[0]), int(out[1]), out[2] == "True"


def test_without_the_subpackage_or_what_it_needs():
    core = run("claimspark.llm", "corpus_pipeline")
    assert core[0] > 70 and core[1:] == (0, False)
    assert run("xxhash") == core


def test_without_the_pipeline_file():
    total, ops, pipeline = run("corpus_pipeline")
    assert not pipeline and total >= 70 + ops
