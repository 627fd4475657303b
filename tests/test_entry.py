import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
SMALL = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80


def test_the_rest_imports_without_the_training_data_operators():
    code = (
        "import sys\n"
        "class Block:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('tidemark.llm'):\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Block())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "assert q and not [n for n in q if n.startswith('op') or n == 'pipeline'], list(q)\n"
        "assert set(e.oracle_sql()) <= set(q)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no tables")
def test_flagship(spark):
    got = entry.entry(spark)
    assert got.columns == ["question_id", "chunk_id", "index", "text"] and got.count() > 0
