import glob
import os
import re
import shutil

import pytest

import corpus_pipeline
from tidewatch.llm import queries, quality
from tidewatch.llm.shared import table

from .test_near_duplicates import brute
from .test_text_operators import brute_leaks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = table(stage(spark, docs, SF), name)
        out.append((name, before, docs))
    return out


def test_columns(results):
    for _, before, after in results[:-1]:
        assert after.columns == before.columns


def test_stages_against_brute_force(spark, results):
    stages = {name: (before.toPandas(), after.toPandas()) for name, before, after in results}
    before, after = stages["quality_filter"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    verdict = quality.classify(spark.createDataFrame(before), labels).toPandas().set_index("doc_id").predicted
    assert set(after.doc_id) == {d for d in before.doc_id if verdict[d] == 1}
    before, after = stages["near_copies"]
    want = {d for d, _, c in brute(list(zip(before.doc_id, before.text)), 5, 80) if d == c}
    assert set(after.doc_id) == want
    before, after = stages["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {d for d, _ in brute_leaks(list(zip(before.doc_id, before.text)), items)}
    assert set(after.doc_id) == set(before.doc_id) - leaks
    before, after = stages["personal_data"]
    assert list(sorted(before.doc_id)) == list(sorted(after.doc_id))
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", t) for t in after.text)
    assert (after.text.str.len() == after.n_chars).all()
    before, after = stages["encoding"]
    assert set(before.doc_id) == set(after.doc_id)


def test_run_is_the_stages(spark, results):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, results[-1][2].collect()))


def test_empty_tables(spark, tmp_path):
    for path in glob.glob(f"{SF}/*.parquet"):
        spark.read.parquet(path).limit(0).write.parquet(str(tmp_path / os.path.basename(path)))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
    shutil.rmtree(tmp_path)


def test_workers_keep_no_memory(spark):
    """After a task of encoding its worker's tables are empty, and texts reach Python in batches of a few MB."""
    import public_tokenizers
    import pyarrow as pa

    from tidewatch.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")

    def kept(batches):
        codec = bpe.load(path, public_tokenizers.PATTERN)
        for b in batches:
            tables = [len(t) + len(t.older) for t in (codec._pairs, codec._short, codec._texts)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(tables)]), pa.array([b.nbytes])], ["entries", "bytes"])

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    assert bpe.token_digests(docs.selectExpr("1 AS doc_id", "text"), path, public_tokenizers.PATTERN).filter("n_tokens > 0").count()
    found = spark.range(0, 64_000, 1, 8).selectExpr("repeat('some words ', 200) AS text").mapInArrow(kept, "entries long, bytes long").collect()
    assert {r["entries"] for r in found} == {0} and max(r["bytes"] for r in found) < 5 << 20
