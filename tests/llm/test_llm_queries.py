"""The registered queries against their SQL twins or brute force, and the pipeline."""

from __future__ import annotations

import collections
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from compare import TABLES, rows_of
from pentarank.llm import quality, queries, secrets
from test_models import plain_random
from test_operators import WORDS, brute_components, brute_fingerprint, brute_spans, shingles


@pytest.mark.parametrize("name", sorted(queries.statements()))
def test_query_matches_its_twin(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.registry()[name](spark, sf_dir)
    result = con.execute(queries.statements()[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.registry())
    assert numbers == list(range(1, 14))


def test_native_queries_run_no_python(spark, sf_dir):
    for name in ("op6_secrets", "op7_decontamination", "op13_merkle"):
        plan = queries.registry()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas")), name


def test_quality_of_the_held_out_fold(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    scored = queries.op2_quality(spark, sf_dir).filter("held_out")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rows = scored.join(labels, "doc_id").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_packing_pads_little(spark, sf_dir):
    rows = queries.op4_packing(spark, sf_dir).groupBy("sequence_id").sum("length").collect()
    used = [r[1] for r in rows]
    assert max(used) <= 4096 and sum(used) / (4096 * len(used)) > 0.97


def test_pipeline_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4]
    left = {r.doc_id for r in docs.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == left
    run = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(map(tuple, run)) == sorted(map(tuple, packed))


def test_pipeline_on_empty_and_odd_documents(spark, sf_dir):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "plain words of a text", "en", "s", 21)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs.limit(0), docs):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, frame, sf_dir)
            assert made.count() <= frame.count() if name != "packing" else True
            assert name == "packing" or made.columns == docs.columns


def brute_masked(text, model):
    spans = [(a, b) for a, _, b in brute_spans(text)] + plain_random(text, model)
    done, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            done += text[at:a] + secrets.MASK
        at = max(at, b)
    return done + text[at:]


def test_pipeline_matches_brute_force(spark, sf_dir):
    def table(name):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    docs = table("documents")
    judge = quality.train(queries.training_rows(docs, table("labels")))
    left = {r.doc_id: r.text for r in docs.collect() if judge.score(r.text) >= 0.7}
    fps = {d: brute_fingerprint(t, 3) for d, t in left.items()}
    roots = brute_components([(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3])
    left = {d: t for d, t in left.items() if roots.get(d, d) == d}
    items = [s for r in table("benchmark").collect() if (s := shingles(r.text))]
    left = {d: t for d, t in left.items() if not any(len(s & shingles(t)) >= 0.8 * len(s) for s in items)}
    kept = spark.createDataFrame(list(left.items()), "doc_id long, text string")
    model = secrets.train(secrets.corpus_samples(kept))
    tokenizer, want = Tokenizer.from_file(WORDS), collections.Counter()
    for d, t in left.items():
        ids = np.array(tokenizer.encode(brute_masked(t, model), add_special_tokens=False).ids + [2], "<u4")
        want.update((d, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()), len(ids)) for s in range(0, len(ids), 4096))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
