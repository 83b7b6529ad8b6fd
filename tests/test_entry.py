"""The driver's contract, and that the core stands without the subpackage of training-data operators."""

import os
import re
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_and_sql_have_known_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(callable(q) for q in e.queries().values())


def test_core_does_not_import_the_subpackage():
    for folder, _, files in os.walk(os.path.join(REPO, "rillstone")):
        if os.sep + "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as s:
                    assert not re.search(r"rillstone\.llm\s+import (?!queries)|from rillstone\.llm|import rillstone\.llm", s.read()), f


def test_entry_without_the_subpackage(tmp_path):
    code = "import sys; sys.modules['rillstone.llm'] = None; import __spark_entry__ as e; assert e.llm is None and 'p5_found' in e.queries() and 'p1_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_flagship_query(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
