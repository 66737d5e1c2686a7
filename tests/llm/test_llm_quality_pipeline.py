"""The quality classifier's accuracy and edge cases; the pipeline against brute-force stages."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from test_llm_decontaminate import brute as brute_hits
from test_llm_group_join import brute_components
from test_llm_shards_mixing import brute_mix

import __spark_entry__ as entry
import corpus_pipeline
from tallyspark.llm import mixing, quality
from tallyspark.llm.entries import MIX_WEIGHTS, REGISTRY, mix_levels, table
from tallyspark.llm.words import NOT_BLANK, slices


def measured(texts):
    return np.concatenate([quality.statistics(w) for _, w in slices(pa.array(texts, pa.string()), NOT_BLANK)])


def test_statistics_do_not_depend_on_the_batch():
    texts = [None, "", "One two two. THREE, 4!!", "x " * 500, "é ü\nä | # ß", " lead"]
    together = measured(texts)
    assert (together == np.concatenate([measured([t]) for t in texts])).all()
    assert np.isfinite(together).all() and (together[:2] == 0).all() and together.shape == (6, len(quality.NAMES))


def test_moments_make_the_shrunk_gaussian(spark):
    rng = np.random.default_rng(1)
    size = len(quality.NAMES)
    x = {k: rng.normal(size=(200, size)) @ rng.normal(size=(size, size)) + k for k in (0, 1)}
    rows = [(k, v.tolist()) for k in (0, 1) for v in x[k]] + [(None, [0.0] * size), (7, [9.0] * size)]
    model = quality.fit(spark.createDataFrame(rows, "y int, stats array<double>"), "y")
    for k in (0, 1):
        share, mean, inverse, logdet = model.classes[k]
        cov = np.cov(x[k].T, bias=True)
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov)) + quality.FLOOR * np.eye(size)
        assert share == 0.5 and np.allclose(mean, x[k].mean(0))
        assert np.allclose(np.linalg.inv(inverse.T @ inverse), cov) and np.isclose(logdet, np.linalg.slogdet(cov)[1])


def test_scores_of_the_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in REGISTRY["op9_quality"](spark, sf_dir).collect()}
    labels = [(r.doc_id, r.quality) for r in table(spark, sf_dir, "labels").collect()]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    held = [(rows[i].score, rows[i].predicted, y) for i, y in labels if rows[i].held_out]
    assert np.mean([p == y for _, p, y in held]) >= 0.97
    good, bad = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert np.mean([g > b for g in good for b in bad]) >= 0.98


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, "s") for i, t in rows], "doc_id long, text string, score double, stats string")


def test_nulls_repeats_and_missing_classes(spark):
    rows = [(1, "a good sentence, this one."), (1, "a good sentence, this one."), (None, None), (2, ""), (3, "x " * 20_000)]
    docs = docs_of(spark, rows)
    label = "doc_id long, quality int, score int"
    none = spark.createDataFrame([], label)
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.score_quality(docs, none).count() == 5 and quality.score_quality(docs.limit(0), none).count() == 0
    only = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, None, 0), (None, 0, 0)], label)
    scored = quality.score_quality(docs, only).collect()
    assert {r.predicted for r in scored} == {1} and [r.held_out for r in scored if r.doc_id is None] == [False]
    kept = quality.keep_good(docs, only)
    assert kept.columns == docs.columns and kept.count() == 5


# --- the pipeline ------------------------------------------------------------------------

@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage got and gave."""
    docs, seen = table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        given = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), f"test-{name}")
        seen.append((given.collect(), docs.collect(), docs.columns))
    return seen


def test_stages_are_the_five_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_columns_stay_those_of_documents(stages):
    own = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [c for _, _, c in stages] == [own] * 4 + [own + ["shard", "slot"]]


def test_quality_stage_drops_what_the_query_rejects(spark, sf_dir, stages):
    good = {r.doc_id for r in REGISTRY["op9_quality"](spark, sf_dir).collect() if r.predicted}
    given, kept, _ = stages[0]
    assert {r.doc_id for r in kept} == good and 0 < len(kept) < len(given)


def test_near_duplicate_stage_keeps_one_of_each_group(stages):
    given, kept, _ = stages[1]
    groups = brute_components([(r.doc_id, r.text) for r in given], 5, 80)
    assert sorted(r.doc_id for r in kept) == sorted(i for i, (_, c) in groups.items() if i == c)


def test_decontamination_stage_drops_documents_with_hits(spark, sf_dir, stages):
    given, kept, _ = stages[2]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    clean = [r[0] for r in brute_hits([(r.doc_id, r.text) for r in given], items) if not r[5]]
    assert sorted(r.doc_id for r in kept) == sorted(clean) and len(kept) < len(given)


def test_mixing_stage_takes_the_budgeted_prefixes(spark, stages):
    given, kept, _ = stages[3]
    rows = spark.createDataFrame(given).select("doc_id", mixing.n_tokens().alias("n"), *[
        c.alias(name) for name, c in mix_levels().items()]).collect()
    want, _ = brute_mix([(r.doc_id, (r.domain, r.lang, r.source), r.n) for r in rows],
                        [MIX_WEIGHTS["domain"], MIX_WEIGHTS["lang"], {}], 90, 1, 5)
    assert sorted((r.doc_id, 1) for r in kept) == want


def test_sharding_stage_places_every_document(stages):
    given, kept, _ = stages[4]
    assert sorted(r.doc_id for r in given) == sorted(r.doc_id for r in kept)
    sizes = np.bincount([r.shard for r in kept], minlength=40)
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 40


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, stages[4][1]))
