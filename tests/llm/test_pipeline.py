import hashlib

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from revisit.llm import catalog, mcd, ngram_join, templates
from revisit.llm.shared import keep, named

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_registered():
    import __spark_entry__ as entry
    known = entry.queries()
    assert known["pipeline"] is corpus_pipeline.run
    for n in range(1, 11):
        assert len([q for q in known if q.startswith(f"op{n}_")]) == 1
    assert set(catalog.SQL) <= set(entry.oracle_sql()) and "pipeline" not in entry.oracle_sql()


def test_run_is_its_stages_by_hand(spark):
    """The stages' decisions, put together outside the pipeline."""
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    frame = lambda ids: spark.createDataFrame([tuple(docs[i]) for i in sorted(ids)], SCHEMA)
    left = {r.doc_id for r in mcd.judge(frame(docs)).collect() if r.kept}
    from test_ngram_join import brute
    comp = brute([(i, docs[i].text) for i in left])
    left = {i for i in left if comp[i] == i}
    held = {r.doc_id for r in templates.contaminated(frame(left), spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
    left -= held
    assert held and len(left) < len(docs)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for i in left:
        ids = model.encode(docs[i].text)
        want.add((i, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))))
    before = named()
    result = corpus_pipeline.run(spark, d)
    assert {tuple(r) for r in result.collect()} == want
    assert named() == before + 1  # only the result's folder is left


def test_stages_keep_the_columns(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = keep(stage(spark, docs, d), "test-stage")
        assert docs.columns == columns, name


def test_odd_rows(spark, rows):
    d = "/root/testdata/sf0.001"
    text = " ".join(f"word{i}" for i in range(60))
    data = [(None, text, None, None, None), (1, text, "en", "s", 9), (1, text, "en", "s", 9), (2, text + " x", "en", "s", 9), (3, None, "en", "s", 0),
            (4, "", None, "s", 0), (5, "word " * 30_000, "en", "s", 1)]
    df = rows(data, SCHEMA).withColumn("kept", F.lit(1)).withColumn("row_key", F.lit("k")).withColumn("component_id", F.lit(3))
    first = keep(corpus_pipeline.quality(spark, df, d), "test-odd")
    assert first.columns == df.columns
    assert sorted(r.doc_id or 0 for r in first.collect()) == [0, 1, 1, 2] and {r.row_key for r in first.collect()} == {"k"}
    second = keep(corpus_pipeline.one_of_each_group(spark, first, d), "test-odd")
    assert sorted(r.doc_id or 0 for r in second.collect()) == [0, 1] and second.columns == df.columns
    assert corpus_pipeline.without_benchmark(spark, second, d).count() == 2
    docs = rows([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, d), "test-empty")
        assert docs.count() == 0
