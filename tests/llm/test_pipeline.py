"""The pipeline's stages on a table small enough to check by hand."""

from pyspark.sql import functions as F

import corpus_pipeline
from sheetwright.llm.jaccard_join import row_key
from tests.llm.test_ops import components_by_hand, dedup_by_hand


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, sf_dir)
        assert rows.columns == docs.columns
        kept[name] = [tuple(r) for r in rows.collect()]
        rows = spark.createDataFrame(kept[name], docs.schema)
    after = kept["toxicity"]
    assert 0.8 * docs.count() < len(after) <= docs.count()
    copies = dedup_by_hand([r[:4] for r in after])
    assert sorted(r[0] for r in kept["exact_dedup"]) == sorted(r[0] for r in copies if r[3])
    near = components_by_hand([r[:4] for r in kept["exact_dedup"]])
    assert sorted(r[0] for r in kept["jaccard_join"]) == sorted(i for i, _, c in near if i == c)
    words = lambda rs: sum(len((r[1] or "").split()) for r in rs)
    mixed = kept["mixing"]
    assert abs(words(mixed) / words(kept["jaccard_join"]) - 1) < 0.25 and {r[0] for r in mixed} <= {r[0] for r in kept["jaccard_join"]}
    out = corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir)
    assert out.count() == len(mixed) and out.filter(F.size("ids") != F.col("n_tokens")).count() == 0


def test_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, "a b c d e f  g", "en", "s", 14), (None, None, None, None, None), (None, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_copies(spark, docs, "")
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [2, None]
    assert corpus_pipeline.drop_near_copies(spark, kept, "").count() == 2


def test_keeps_one_of_each_near_group(spark):
    base = [" ".join(f"{w}{k}" for k in range(60)) for w in "abcd"]
    rows = [(1, base[0]), (None, base[0] + " more"), (None, base[1]), (None, base[1] + " more"), (7, base[2]), (7, base[2] + " more"), (7, base[3]), (7, base[3]), (None, None), (None, "  ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    group = lambda t: base.index(t.removesuffix(" more")) if (t or "").strip() else t
    assert sorted(((i, group(t)) for i, t in got), key=repr) == sorted([(1, 0), (None, 1), (7, 2), (7, 3), (None, None), (None, "  ")], key=repr)
    keys = docs.filter("text IS NOT NULL").select("doc_id", "text", F.xxhash64("text", "doc_id").alias("k")).collect()
    assert all(row_key(r.doc_id, r.text) == r.k for r in keys)


def test_stages_on_odd_tables(spark):
    """Empty tables, nulls in every column, repeated rows and columns with the operators' own names."""
    sf_dir, schema = "/root/testdata/sf0.001", "doc_id long, text string, lang string, source string, n_chars int, id long, key string, set int, block int, shard string"
    long = "very long text " * 20_000
    rows = [(1, "some words here", "en", "a", 15, 5, "k", 1, 2, "s"), (1, "some words here", "en", "a", 15, 5, "k", 1, 2, "s"), (None, None, None, None, None, None, None, None, None, None), (2, "", None, None, 0, None, None, None, None, None), (3, long, None, "b", len(long), 1, None, None, None, None), (None, "no id", "de", None, 5, 1, None, None, None, None)]
    for docs in (spark.createDataFrame([], schema), spark.createDataFrame(rows, schema)):
        before = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns
            if name != "mixing":
                kept = {(r.doc_id, r.text) for r in out.collect()}
                assert kept <= {(r[0], r[1]) for r in rows} and len(kept) <= before
            if before and name == "exact_dedup":
                assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(1, "some words here"), (2, ""), (3, long), (None, "no id")], key=repr)
        assert corpus_pipeline.encode(spark, docs, sf_dir).count() == before
