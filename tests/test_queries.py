from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from compare import TABLES, rows_of
from pentarank.plans import oracles, queries

QUERIES = queries.registry()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert QUERIES.keys() == oracles.statements().keys()
    assert QUERIES.keys() <= contract.queries().keys() and QUERIES.keys() <= contract.oracle_sql().keys()


@pytest.mark.parametrize("gone", ["corpus_pipeline", "pentarank.llm", "ahocorasick", "xxhash", "public_tokenizers"])
def test_entry_works_without_optional_modules(gone):
    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith({gone!r}):
            raise ModuleNotFoundError("not here", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
from pentarank.plans.queries import registry
assert e.queries().keys() == registry().keys() and e.oracle_sql().keys() == registry().keys()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(contract.__file__).parent)


@pytest.mark.parametrize("key", QUERIES)
def test_query_matches_its_twin(spark, sf_dir, duck, key):
    df = QUERIES[key](spark, sf_dir)
    result = duck.execute(oracles.statements()[key])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    got = rows_of(df.columns, df.collect())
    assert got and got == rows_of(names, result.fetchall())


@pytest.mark.parametrize("key", QUERIES)
def test_no_query_multiplies_rows(spark, sf_dir, key):
    plan = QUERIES[key](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_needed_columns(spark, sf_dir):
    def plan(query):
        return query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()

    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan(queries.metric_log)
    assert "PushedFilters: [IsNotNull(quality), EqualTo(quality,0)" in plan(queries.retry_failed_only)
    assert "Python" not in plan(queries.similarity_evaluation)


def test_row_metrics_need_one_exchange_of_sums(spark, sf_dir):
    plan = queries.generation_accuracy(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan


def test_answers_are_read_once(spark, sf_dir):
    for query in (queries.extract_image_choice, queries.generation_accuracy):
        plan = query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") <= 6


def test_both_forms_come_from_one_scan(spark, sf_dir):
    for query, scans in ((queries.pair_rows, 1), (queries.sft_dataset_assemble, 1), (queries.chat_messages, 2)):
        plan = query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parquet") == scans and "Union" not in plan


def test_likelihood_of_row_sequences_moves_no_logits(spark, sf_dir):
    plan = queries.perplexity_sequences(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SinglePartition" in plan
