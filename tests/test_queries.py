"""Every registered query of the library itself against its SQL, and that it stands alone."""

import os
import subprocess
import sys

import duckdb
import pytest

from seqloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name not in catalogue.ORACLE:
        assert got
        return
    rel = con.sql(catalogue.ORACLE[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[k]) for k in at) for r in rel.fetchall())


def test_the_library_stands_without_the_optional_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for item in ("seqloom", "__spark_entry__.py"):
        os.system(f"cp -r {root}/{item} {tmp_path}/")
    os.system(f"rm -rf {tmp_path}/seqloom/llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'kmer_count_all' in q and not any(x.startswith('op') for x in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q); print('ok')"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.strip() == "ok", out.stderr


def test_the_library_stands_where_the_optional_subpackage_cannot_be_imported(tmp_path):
    """A missing dependency of it takes none of the library's own queries with it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for module in ("xxhash", "sentencepiece", "tiktoken"):
        (tmp_path / f"{module}.py").write_text(f"raise ImportError('no {module}')\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'kmer_count_all' in q and 'op10_simhash' not in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q); print('ok')"
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=root, env={**os.environ, "PYTHONPATH": f"{tmp_path}:{root}"}, capture_output=True, text=True)
    assert out.stdout.strip() == "ok", out.stderr
