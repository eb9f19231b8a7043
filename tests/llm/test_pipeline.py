"""Mixing, SQL oracles, the registry and the pipeline."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from carelens.llm.mix_sources import leaf_budgets, mix_sources, mixed_documents
from carelens.llm.registry import MIX_WEIGHTS, domain
from tests.llm import brute


@pytest.mark.parametrize("name", ["op8_mix_sources", "op10_line_rules", "op12_warc_index", "op13_merkle_manifest"])
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got = entry.queries()[name](spark, sf)
    want = con.sql(entry.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = sorted(map(tuple, got.select(*names).collect()))
    assert rows == sorted(want.project(", ".join(names)).fetchall())


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_budgets_go_to_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("a", "en", "s1", 10, 1), ("a", "en", "s2", 1000, 1), ("a", "de", "s3", 1000, 1), ("b", "en", "s4", 30, 1)],
        "domain string, lang string, source string, tokens long, n_docs long")
    got = {r.source: r.got for r in leaf_budgets(
        leaves, {"domain": {"a": 1, "b": 1}, "lang": {"en": 1, "de": 1}}, 400, 1, 1).collect()}
    assert got["s4"] == 30 and sum(got.values()) == 400
    assert got["s1"] == 10 and got["s2"] == 175 and got["s3"] == 185  # s1's shortage stays in a/en
    none = leaf_budgets(leaves, {"domain": {"a": 0}}, 400, 1, 1).collect()
    assert {r.source: r.got for r in none} == {"s4": 30}


def test_mix_takes_a_prefix_of_epochs(make, corpus):
    docs = make(corpus + [corpus[0], (None, "ban cor. dus")])
    total = sum(len(brute.words(t)) for _, t in corpus) + len(brute.words(corpus[0][1])) + 3
    for share, bucket in ((0.5, 2), (1.7, 2000)):
        got = mix_sources(docs, F.lit("d"), {}, budget_share=share, max_epochs=2, per_bucket=bucket).collect()
        assert sum(r.taken for r in got) == int(total * share)
        assert all(0 < r.taken <= r.n_tokens for r in got)
        cut = [r for r in got if r.taken < r.n_tokens]
        assert len(cut) <= len({(r.lang, r.source) for r in got})
    same = [sorted((r.doc_id or -1, r.epoch, r.taken) for r in mix_sources(
        docs, F.lit("d"), {}, per_bucket=b).collect()) for b in (1, 7, 2000)]
    assert same[0] == same[1] == same[2]
    assert mix_sources(make([]), F.lit("d"), {}).count() == 0
    texts = mixed_documents(docs, F.lit("d"), {})
    assert set(docs.columns) < set(texts.columns)
    for r in texts.collect():
        assert len(brute.words(r.text)) == r.taken


def test_pipeline_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line dedup", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = rows(docs), stage(spark, docs, sf)
        assert out.columns == docs.columns
        after = rows(out)
        if name == "line dedup":
            gone = brute.lines_removed(sorted(before.items()))
            want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, [])) for d, t in before.items()}
            assert after == {d: t for d, t in want.items() if t.strip() or not before[d].strip()}
        elif name == "MinHash near-dedup":
            classes = brute.near_classes(sorted(before.items()))
            assert set(after) == set(classes.values())
        elif name == "benchmark decontamination":
            assert set(after) == set(before) - {d for _, d in brute.contained(sorted(before.items()), bench)}
        else:
            assert set(after) <= set(before)
    final = corpus_pipeline.run(spark, sf)
    assert 0 < final.count() and final.agg(F.sum("taken")).first()[0] > 0
    assert domain() is not None and MIX_WEIGHTS


def test_mixed_documents_of_equal_rows_and_clashing_names(spark):
    rows = [(1, "a b c d", "en", "s1", 9, 9, 9, 9), (1, "a b c d", "en", "s1", 9, 9, 9, 9)]
    schema = "doc_id long, text string, lang string, source string, domain int, epoch int, taken int, mix_taken int"
    got = mixed_documents(spark.createDataFrame(rows, schema), F.lit("d"), {}).collect()
    assert [(r.text, r.epoch, r.n_tokens, r.taken, r.domain, r.mix_taken) for r in got] == [("a b c d", 0, 4, 4, "d", 9)]
    rows = [(i % 3, f"w{i % 3} x y z", "en", "s1", 9, 9, 9, 9) for i in range(60)]
    for share in (0.3, 0.77, 1.4):
        got = mixed_documents(spark.createDataFrame(rows, schema), F.lit("d"), {}, budget_share=share).collect()
        assert sum(r.taken for r in got) == int(240 * share) == sum(len(brute.words(r.text)) for r in got)
