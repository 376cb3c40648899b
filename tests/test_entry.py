import subprocess
import sys

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_need_the_llm_package():
    code = "import sys; sys.modules['attesta.llm'] = None; import __spark_entry__ as e; assert not any(k[0] == 'p' and k[1].isdigit() for k in e.queries()); assert len(e.queries()) > 50"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 0


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["run_id", "claim_id", "claim", "supporting", "independent", "contradicting", "alerts", "verdict", "reason"] and df.count() > 0
