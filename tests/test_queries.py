"""Every query of the library against its oracle SQL; those without one must give rows."""

import pytest

from tests.oracle import differences, duck
from tidemill.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, sf_dir, con, name):
    assert differences(spark, QUERIES[name], ORACLE_SQL[name], sf_dir, con) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_imports_and_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())


def test_entry_works_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tidemill", tmp_path / "tidemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(e.oracle_sql()))"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


@pytest.mark.parametrize("module", ["public_tokenizers", "xxhash", "tidemill.llm.registry"])
def test_entry_works_if_something_of_the_llm_side_is_missing(module):
    import subprocess
    import sys
    from pathlib import Path

    code = f"import sys; sys.modules[{module!r}] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True)
