from collections import Counter

import corpus_pipeline
from ledgerline.llm import queries

from .fixtures import documents, rows
from .test_dedup import brute_components, brute_exact, brute_fingerprint
from .test_mix_pack import check

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = corpus_pipeline.reject_toxic(spark, docs, SF)
    held = clean.collect()
    assert clean.schema == docs.schema
    flagged = {r.doc_id for r in queries.op4_toxicity(spark, SF).where("predicted = 1").collect()}
    assert {r.doc_id for r in held} == {r.doc_id for r in docs.collect()} - flagged

    once = corpus_pipeline.drop_copies(spark, clean, SF)
    _, kept = brute_exact([(r.doc_id, r.text) for r in held])
    assert sorted(r.doc_id for r in once.collect()) == sorted(kept.values()) and once.columns == docs.columns

    held = once.collect()
    near = corpus_pipeline.drop_near_copies(spark, once, SF)
    want = {c for _, _, c in brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in held])}
    assert {r.doc_id for r in near.collect()} == want and near.columns == docs.columns

    mixed = corpus_pipeline.mix_sources(spark, near, SF)
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) <= want and max(times.values()) <= 3 and mixed.columns == docs.columns

    unique = {r.doc_id: r.text for r in near.collect()}
    packed = corpus_pipeline.pack_windows(spark, near, SF).collect()
    padding, _ = check(packed, unique)
    assert padding <= 4096 * near.rdd.getNumPartitions()


def test_stages_bear_awkward_rows(spark, tmp_path):
    """Null and empty texts, rows that repeat, a row without doc_id, columns with clashing names; then no rows at all."""
    spark.createDataFrame([(i, int(i % 7 == 0), 1) for i in range(40)] + [(None, 1, None), (3, None, 1)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path)).collect()
        if name != "packing":
            assert len(out) > 0 and set(out[0].asDict()) == set(docs.columns), name
            docs = spark.createDataFrame(out, docs.schema).repartition(3)
    assert sum(r.length for r in out) == sum({(r.doc_id, r.sequence_id, r.offset): r.length for r in out}.values()) and {r.doc_id for r in out} <= {r[0] for r in rows()}
    documents(spark).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_gives_pieces(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "source mixing", "packing"]


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and set(queries.QUERIES) <= names and set(queries.ORACLE) <= set(__spark_entry__.oracle_sql())
