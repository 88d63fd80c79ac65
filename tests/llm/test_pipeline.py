"""The pipeline's stages against plain versions of what each decides."""

import os
import shutil
import subprocess
import sys
from collections import defaultdict

import numpy as np
import pytest

import brute
import corpus_pipeline
from rasterloom.llm import common, packing, registry

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


def test_stages_decide_as_plain_versions(spark):
    docs = common.documents(spark, SF)
    docs = docs.union(spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "123 456 --", "en", "s", 10)], docs.schema)).cache()
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    one = common.stored(stages["language_id"](spark, docs, SF), "one")
    assert one.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in one.collect()} == {9001, 9002}

    two = common.stored(stages["exact_dedup"](spark, one, SF), "two")
    last = {}
    for r in one.collect():
        key = r.text.encode().translate(brute.FOLD)
        last[key] = max(last.get(key, -1), r.doc_id)
    assert {r.doc_id for r in two.collect()} == set(last.values()) and two.columns == docs.columns

    three = common.stored(stages["near_dedup"](spark, two, SF), "three")
    want = brute.near_components([(r.doc_id, r.text) for r in two.collect()], 5)
    assert {r.doc_id for r in three.collect()} == set(want.values()) and three.columns == docs.columns

    four = common.stored(stages["mixing"](spark, three, SF), "four")
    assert sorted(r.doc_id for r in four.collect()) == sorted(set(want.values())) and four.columns == docs.columns

    tokens = defaultdict(int)
    for p in stages["packing"](spark, four, SF).collect():
        tokens[p.doc_id] += p.length
    encode = packing.Encoder(packing.default_path())
    assert dict(tokens) == {r.doc_id: len(encode(r.text)) + 1 for r in four.collect()}


def _plain(rows):
    """The tokens of the documents that stay, by id, for rows (doc_id, text) with distinct ids."""
    last = {}
    for i, t in rows:
        if any(map(str.isalpha, t or "")):
            last[t.encode().translate(brute.FOLD)] = max(i, last.get(t.encode().translate(brute.FOLD), -1))
    texts = dict(rows)
    kept = set(brute.near_components([(i, texts[i]) for i in sorted(last.values())], 5).values())
    encode = packing.Encoder(packing.default_path())
    return {i: [*encode(texts[i]).tolist(), 0] for i in kept}


def test_run_equals_plain_stages(spark):
    rows = [(r.doc_id, r.text) for r in common.documents(spark, SF).collect()]
    found = defaultdict(list)
    for p in corpus_pipeline.run(spark, SF).orderBy("doc_id", "start").collect():
        assert p.start == len(found[p.doc_id])
        found[p.doc_id] += np.frombuffer(p.ids, np.uint32).tolist()
    assert dict(found) == _plain(rows)


def test_run_on_odd_tables(spark, tmp_path):
    """No rows; further columns with clashing names; null ids; ids that stand for several texts."""
    long = " ".join(f"word{i}" for i in range(50))
    odd = [(1, "Some text here", "en"), (1, "Another one altogether", None), (2, long, None), (None, long + " end", "en"), (None, None, None), (3, "", "en"), (4, "12 34", "de"), (2, long, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, at int, key string, kept_id int, slot int"
    for name, rows in (("none", []), ("odd", odd)):
        spark.createDataFrame([(i, t, k, None, 0, 1, "k", 2, 3) for i, t, k in rows], schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    pieces = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert {p.doc_id for p in pieces} == {1, 2, None} and sum(p.start == 0 for p in pieces if p.doc_id == 1) == 2
    for stage, f in corpus_pipeline.STAGES[:-1]:
        docs = common.documents(spark, str(tmp_path / "odd"))
        assert f(spark, docs, "").columns == docs.columns and f(spark, docs.filter("false"), "").count() == 0


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 11))


def test_sql_equals_queries(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    for name, sql in registry.ORACLE_SQL.items():
        df, expected = registry.QUERIES[name](spark, SF), con.sql(sql)
        columns = sorted(df.columns)
        assert sorted(expected.columns) == columns
        places = [expected.columns.index(c) for c in columns]
        assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in places)) for r in expected.fetchall()), name


@pytest.mark.parametrize("gone", [("rasterloom/llm", "tests/llm"), ("rasterloom/llm", "tests/llm", "corpus_pipeline.py")])
def test_the_rest_works_without_the_text_operators(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for path in gone:
        shutil.rmtree(copy / path) if os.path.isdir(copy / path) else os.remove(copy / path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'px_vote_opaque' in q and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q); e.oracle_sql()"
    env = {**os.environ, "PYTHONPATH": str(copy)}
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=env)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_options.py", "tests/test_pdn.py"], cwd=copy, check=True, env=env)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "--collect-only", "tests"], cwd=copy, check=True, env=env)


def test_a_missing_library_is_an_error(tmp_path):
    """Only the text operators themselves may be missing, not what they need."""
    (tmp_path / "xxhash.py").write_text("raise ModuleNotFoundError('no xxhash', name='xxhash')")
    env = {**os.environ, "PYTHONPATH": f"{tmp_path}{os.pathsep}{ROOT}"}
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=env, capture_output=True).returncode
