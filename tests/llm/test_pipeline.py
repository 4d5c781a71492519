"""The registered text queries, their SQL, and the pipeline against plain versions of its stages."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
sys.path[:0] = [str(Path(__file__).parent), str(ROOT), str(ROOT / "tools")]
import compare  # noqa: E402
import corpus_pipeline  # noqa: E402
from helpers import EXTRA, ODD_ROWS, linked_components, odd  # noqa: E402
from test_operators import TOKENIZER, check_packing, plain_exact, plain_hits  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from sarmotion.llm import language_id  # noqa: E402
from sarmotion.llm.queries import ORACLE, QUERIES  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, name):
    same, note = compare.compare(spark, compare.connect(SMALL), SMALL, name)
    assert same, note


def test_queries_are_registered():
    assert {int(n.split("_")[0][2:]) for n in QUERIES if n.startswith("op")} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


COLUMNS = {
    "op1_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op2_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op4_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op5_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op8_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op13_quality": ["doc_id", "held_out", "score", "predicted"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_returns_every_document(spark, name):
    found = QUERIES[name](spark, SMALL)
    assert found.columns[: len(COLUMNS[name])] == COLUMNS[name]
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert found.select("doc_id").distinct().count() == documents.count()


def plain_pipeline(spark, rows: dict, lang: dict) -> dict:
    """The texts that each stage's rule keeps; the language model is the stage's own."""
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_id.fit(documents)
    rejected = {r["doc_id"] for r in language_id.identified(documents, model).where("rejected").collect()}
    kept = {i: t for i, t in rows.items() if i not in rejected}
    unique = {i for (i, keep, _, _, _) in plain_exact(list(kept.items())) if i == keep}
    kept = {i: t for i, t in kept.items() if i in unique}
    component = linked_components(kept, 80)
    kept = {i: t for i, t in kept.items() if component[i] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    hits = {i: plain_hits(t, items) for i, t in kept.items()}
    return {i: t for i, t in kept.items() if not (hits[i][1] > 0 and 20 * hits[i][1] >= hits[i][0])}


def test_pipeline_keeps_what_its_rules_keep(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    rows, lang = {r["doc_id"]: r["text"] for r in documents}, {r["doc_id"]: r["lang"] for r in documents}
    expected = plain_pipeline(spark, rows, lang)
    assert 0 < len(expected) < len(rows)
    check_packing(list(expected.items()), corpus_pipeline.run(spark, SMALL).collect(), 2048)


def test_stages_keep_the_columns_and_survive_odd_rows(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "minhash_near_dedup", "decontamination", "best_fit_packing"]
    for rows in (odd(spark), odd(spark).limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, SMALL)
            assert out.columns == rows.columns and out.count() <= rows.count()
        assert corpus_pipeline.STAGES[-1][1](spark, rows, SMALL).count() >= rows.count()
    # Rows without an id are decided by the language alone.
    kept = corpus_pipeline.near_copies(spark, odd(spark), SMALL)
    assert kept.where(F.col("doc_id").isNull()).count() == sum(i is None for i, _ in ODD_ROWS)
    assert len(EXTRA) + 5 == len(kept.columns)
    assert TOKENIZER.endswith(corpus_pipeline.TOKENIZER)
