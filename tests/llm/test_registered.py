"""The registered queries: there, and equal to their SQL where they have one."""

import pytest
from compare import connect, differences

import corpus_pipeline
from lendlens.llm.queries import ORACLE, QUERIES


def test_every_operator_is_registered_once():
    from __spark_entry__ import oracle_sql, queries

    numbers = [name[2:].split("_")[0] for name in QUERIES]
    assert sorted(map(int, numbers)) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert set(ORACLE) <= set(oracle_sql())
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "near dedup", "benchmark decontamination", "byte-level BPE"
    ]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf_dir, name):
    found = differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE[name])
    assert not found, "\n".join(found)


def test_core_queries_do_not_need_the_corpus_part():
    """Without the subpackage or the pipeline, the other queries are still there."""
    import subprocess
    import sys

    code = (
        "import sys; sys.modules['lendlens.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 100 and not any(n.startswith('op1') or n == 'pipeline' for n in e.queries())\n"
        "assert e.oracle_sql()\n"
    )
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
