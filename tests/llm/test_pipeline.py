import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_shingles import brute as brute_groups
from tests.oracle import check, connection
from tonelake.llm import queries, toxicity
from tonelake.llm.common import keyed


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The input of each stage and the last output, each written and reread."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, docs]


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_columns_stay(stages):
    assert all(set(d.columns) == set(stages[0].columns) for d in stages[:5])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near-duplicates", "decontamination", "sentencepiece"]


def test_toxic_documents_go(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = {r.doc_id for r in toxicity.toxicity(stages[0], labels).where("predicted = 1").collect()}
    assert rows(stages[1]) == [r for r in rows(stages[0]) if r[0] not in bad]


def test_line_copies_go(stages):
    before = stages[1].collect()
    rids = {(r.doc_id, r.text): r.rid for r in keyed(stages[1], "doc_id", "text").collect()}
    cut = {d: (n, t) for d, _, n, t in brute_lines([(r.doc_id, r.text) for r in before], rids, 50)}
    want = sorted((r.doc_id, cut[r.doc_id][1]) for r in before if not cut[r.doc_id][0] or cut[r.doc_id][1].strip())
    got = sorted((r.doc_id, r.text) for r in stages[2].collect())
    assert got == want
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_one_of_each_group_stays(stages):
    want, _ = brute_groups([(r.doc_id, r.text) for r in stages[2].collect()])
    assert sorted(r.doc_id for r in stages[3].collect()) == want


def test_benchmark_passages_go(spark, sf_dir, stages):
    squash = lambda t: " ".join(t.split())
    items = [squash(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = {r.doc_id for r in stages[3].collect() if any(i in squash(r.text) for i in items)}
    kept = {r.doc_id for r in stages[4].collect()}
    assert not hit & kept and len({r.doc_id for r in stages[3].collect()} - kept - hit) <= 2


def test_ids_are_the_librarys(stages):
    sp = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.TOKENIZER)
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    got = stages[5].collect()
    assert len(got) == len(texts) and all(r.ids == sp.encode(texts[r.doc_id]) and r.lossless for r in got)


def test_clashing_columns_nulls_and_empty_tables(spark, sf_dir):
    docs = spark.createDataFrame(
        [(1, "a long line that is here twice, word for word, in two documents\nx", "en", "s", 9, 1, 1.0), (2, "a long line that is here twice, word for word, in two documents\ny", "en", "s", 9, 1, 1.0), (None, None, None, None, None, None, None), (3, "", "en", "s", 0, 1, 1.0), (3, "", "en", "s", 0, 1, 1.0)],
        "doc_id long, text string, lang string, source string, n_chars long, rid int, score double",
    )
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, table, sf_dir)
            assert out.columns == table.columns
            table = spark.createDataFrame(out.collect(), out.schema)
        assert stage and corpus_pipeline.STAGES[4][1](spark, table, sf_dir).where(~F.col("lossless")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, sf_dir, name):
    check(spark, connection(sf_dir), sf_dir, queries.QUERIES[name], queries.ORACLES.get(name))
