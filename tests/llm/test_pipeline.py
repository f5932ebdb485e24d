import re

import corpus_pipeline
import pytest

from docsieve.llm import packing, queries, toxicity
from docsieve.llm.common import default_tokenizer

from . import fixtures
from .. import oracle
from .test_dedup import brute_join
from .test_others import brute_leaks

FOLDER = "/root/testdata/sf0.001"


def ids_of(rows):
    return sorted(r["doc_id"] for r in rows.select("doc_id").collect())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    if name in queries.SQL:
        oracle.same(spark, oracle.connection(FOLDER), FOLDER, queries.QUERIES[name], queries.SQL[name])
    else:
        assert queries.QUERIES[name](spark, FOLDER).count() > 0


def test_stages_keep_the_columns_and_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert kept < ids if name != "toxicity" else kept <= ids
        ids = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r["doc_id"] for r in packed} == ids
    whole = corpus_pipeline.run(spark, FOLDER)
    assert whole.count() == len(packed)


def test_stages_against_brute_force(spark):
    """Each stage on the small fixture, and on documents that hold items of the benchmark, whole and with a word changed."""
    rows = dict(fixtures.texts())
    docs = fixtures.table(spark)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    toxic = {r["doc_id"] for r in toxicity.score(docs, toxicity.train(docs, labels)).where("toxic").collect()}
    assert ids_of(corpus_pipeline.toxicity_stage(spark, docs, FOLDER)) == sorted(set(rows) - toxic)
    by_text = {}
    for d, t in rows.items():
        by_text.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), d)
    kept = corpus_pipeline.exact_dedup_stage(spark, docs, FOLDER)
    assert ids_of(kept) == sorted(by_text.values())
    want = brute_join([(d, rows[d]) for d in by_text.values()], corpus_pipeline.NEAR)
    near = corpus_pipeline.near_dedup_stage(spark, kept, FOLDER)
    assert ids_of(near) == sorted(d for d, v in want.items() if v[1] == d) and len(want) > near.count()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").limit(4).collect()]
    held = [(1000 + i, f"{fixtures.PASSAGE} {t} and more") for i, t in items] + [(2000 + i, f"so {t.replace(t.split()[4], 'other', 1)}") for i, t in items]
    clean = [(d, t) for d, t in rows.items() if len((t or "").split()) < 300]
    out = ids_of(corpus_pipeline.decontamination_stage(spark, fixtures.table(spark, clean + held), FOLDER))
    assert out == sorted({d for d, _ in clean + held} - {d for d, _ in brute_leaks(clean + held, items)}) and set(out) == {d for d, _ in clean}
    packed = corpus_pipeline.packing_stage(spark, docs, FOLDER).collect()
    encode = packing.encoder(default_tokenizer())
    for d, t in rows.items():
        n = len(encode([t or ""])[0]) + 1
        pieces = sorted((r["start"], r["length"]) for r in packed if r["doc_id"] == d)
        assert [length for _, length in pieces] == packing.decompose(n) and [s for s, _ in pieces] == [sum(packing.decompose(n)[:i]) for i in range(len(pieces))]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_on_odd_and_empty_tables(spark, stage):
    assert stage[1](spark, fixtures.empty(spark), FOLDER).count() == 0
    got = stage[1](spark, fixtures.odd(spark), FOLDER).collect()
    # Null and repeated ids: rows are documents of their own; of four distinct texts one of each stays.
    want = {"exact_dedup": 4, "near_dedup": 4}.get(stage[0], 7)
    assert len(got) == want if stage[0] != "packing" else sorted({(r["doc_id"] is None, r["doc_id"]) for r in got}, key=repr) == sorted([(True, None), (False, 1), (False, 2)], key=repr)
