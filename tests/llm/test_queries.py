"""Registered corpus queries against SQL, held-out accuracy and a plain pipeline."""

import collections
import os

import pandas as pd
import pytest
from harness import check, duck
from odd_documents import COLUMNS, VOCABULARY, odd_rows
from test_operators import plain_base, plain_near, star, words
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    result = check(spark, duck(SF), SF, name, QUERIES, ORACLES)
    assert result.startswith("ok"), result


def test_near_query_equals_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in QUERIES["op6_near_dedup"](spark, SF).collect())
    assert got == collections.Counter(plain_near(list(zip(docs.doc_id.tolist(), docs.text, strict=True)), 4))


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op5_quality_classifier"](spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95


def test_stages_on_odd_rows(spark, odd, none, tmp_path):
    """Every stage but the last returns the columns of its documents, also of odd and of no rows."""
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "packing":
                assert out.dtypes == docs.dtypes, name
            out.write.mode("overwrite").parquet(str(tmp_path / name))
    assert COLUMNS and odd_rows()


def test_near_stage_keeps_one_of_a_star(spark):
    rows = star(300, changed=4)
    assert {c for _, _, c in plain_near(rows, 5)} == {0}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near dedup"](spark, docs, SF).collect()] == [0]


def test_pipeline_equals_plain_stages(spark, tmp_path):
    """Quality, exact and near stages row by row; mixing and packing by their sums."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = (before.toPandas(), docs.toPandas())
    given, out = kept["quality rules"]
    base = [plain_base(t) for t in given.text]
    # so few labels certify no rule: the base alone decides
    assert sorted(out.doc_id) == sorted(i for i, b in zip(given.doc_id, base, strict=True) if not (b[0] < 20 or 100 * b[4] > 30 * b[0]))
    given, out = kept["exact dedup"]
    assert sorted(out.doc_id) == sorted(given.groupby("text").doc_id.max())
    given, out = kept["near dedup"]
    want = {c for _, n, c in plain_near(list(zip(given.doc_id.tolist(), given.text, strict=True)), 5)}
    assert sorted(out.doc_id) == sorted(want)
    given, out = kept["mixing"]
    total = sum(len(words(t)) for t in given.text)
    assert out.groupby("doc_id").size().max() <= 3 and 0.85 * total < sum(len(words(t)) for t in out.text) <= total
    given, out = kept["packing"]
    whole = Tokenizer.from_file(f"{VOCABULARY}/byte_bpe_50k.json")
    assert out.length.sum() == sum(len(whole.encode(t, add_special_tokens=False).ids) + 1 for t in given.text)
    assert out.groupby("sequence_id").length.sum().max() <= 1024
