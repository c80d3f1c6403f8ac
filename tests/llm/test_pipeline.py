import corpus_pipeline
from brute import contamination, near_components, normal
from test_tokens import check_pieces

from poolwise.llm.language_id import identify

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark, sample):
    docs, texts = sample
    known = {r.doc_id for r in identify(docs).collect() if not r.rejected}
    first = {}
    for doc in sorted(known):
        first.setdefault(normal(texts[doc]), doc)
    left = {doc: texts[doc] for doc in first.values()}
    left = {doc: texts[doc] for doc, c in near_components(left).items() if doc == c}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    left = {doc: t for doc, t in left.items() if not contamination(t, items)[0]}
    check_pieces(corpus_pipeline.run(spark, SF).collect(), left)


def test_stages_keep_the_columns_and_survive_odd_rows(spark, make_docs, tmp_path):
    docs = make_docs([(1, None), (2, "the of and with"), (2, "the of and with"), (None, "the the of"), (5, "12"), (6, "the of and  with")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_out = stage(spark, docs, SF)
        assert docs_out.columns == docs.columns
        docs_out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert 0 < docs.count() <= 3
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, make_docs([]), SF).count() == 0
