"""The registered queries against SQL, and that the rest of the library does not need this subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

from boolsieve.llm.queries import ORACLE_SQL, QUERIES
from oracle import compare

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    compare(QUERIES[name](spark, sf), ORACLE_SQL[name], sf)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_entry_lives_without_it(tmp_path):
    for p in ("__spark_entry__.py", "boolsieve"):
        subprocess.run(["cp", "-r", ROOT / p, tmp_path], check=True)
    subprocess.run(["rm", "-r", tmp_path / "boolsieve/llm"], check=True)
    code = "import __spark_entry__ as e; assert e.llm is None and len(e.queries()) > 50 and not any(n.startswith('op1_') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_a_broken_import_is_not_hidden(tmp_path):
    for p in ("__spark_entry__.py", "boolsieve", "corpus_pipeline.py"):
        subprocess.run(["cp", "-r", ROOT / p, tmp_path], check=True)
    (tmp_path / "boolsieve/llm/media.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode and "no_such_module" in done.stderr
