import pytest
from oracle import compare
from tessella import catalogue, catalogue_more  # noqa: F401  its queries join the catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, name):
    if name in catalogue.ORACLE_SQL:
        compare(spark, name, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], SF)
    else:
        catalogue.QUERIES[name](spark, SF).collect()


def test_entry_works_without_the_llm_folders(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tessella", f"{tmp_path}/tessella", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(k.startswith('op') and '_' in k and k[2].isdigit() for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
