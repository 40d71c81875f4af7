"""The corpus pipeline: every stage on what the one before it kept."""

import corpus_pipeline
from lapforge.llm.latent_leaks import benchmark_leaks
from lapforge.llm.mixing import mix_report
from lapforge.llm.parity_join import parity_sketch_join
from lapforge.llm.tables import cut_lineage, read_table


def test_stages(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut_lineage(stage(spark, docs, sf_dir), name)
        kept[name] = docs.count()
        if name != "token_output":
            assert docs.columns == columns
        if name == "near_duplicates":
            assert parity_sketch_join(docs).where("component_id <> doc_id").count() == 0
        if name == "decontamination":
            assert benchmark_leaks(docs, read_table(spark, sf_dir, "benchmark")).count() == 0
            want = mix_report(docs).where("taken > 0").count()
        if name == "mixing":
            assert docs.select("doc_id").distinct().count() == want
    assert 150 < kept["toxicity"] <= 200 and 100 < kept["decontamination"] < kept["toxicity"]
    assert kept["token_output"] == kept["mixing"]


def test_empty(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    assert docs.count() == 0


def test_odd_rows_and_columns(spark, sf_dir):
    """Nulls, empty and very long texts, repeated rows and clashing names in every stage."""
    from pyspark.sql import functions as F
    plain = read_table(spark, sf_dir, "documents")
    long = " ".join(f"w{i}" for i in range(30_000))
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (None, "some text here", "en", None, 3), (10**6, None, "en", "a", None), (10**6 + 1, "", None, "a", 0),
         (10**6 + 2, " \n ", "en", None, 3), (10**15, long, "en", "a", 1), (10**6 + 4, "one", "en", "a", 3), (10**6 + 4, "one", "en", "a", 3)],
        plain.schema)
    names = ["node", "key", "start", "size", "sid", "_tie", "_row", "_doc", "_text", "uses", "block", "row", "p", "toxic", "component_id"]
    docs = cut_lineage(plain.union(odd).withColumns({c: F.lit(c) for c in names}), "odd")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = cut_lineage(stage(spark, docs, sf_dir), name)
        assert out.columns == docs.columns and out.where(" or ".join(f"{c} <> '{c}'" for c in names)).count() == 0
        assert out.where("doc_id is null").count() == 2
        left = {r.doc_id: r.n for r in out.where("doc_id >= 1000000").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
        assert left == {10**6: 1, 10**6 + 1: 1, 10**6 + 2: 1, 10**6 + 4: 2, 10**15: 1}
    mixed = cut_lineage(corpus_pipeline.mixing(spark, docs, sf_dir), "mixed")
    assert mixed.columns == docs.columns and mixed.where("text is null or trim(text) = ''").count() == 0
    assert corpus_pipeline.token_output(spark, mixed, sf_dir).count() == mixed.count()
