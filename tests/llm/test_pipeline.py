"""The pipeline's stages on edge cases and on the test tables."""

from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline as cp
from molframe.llm import near_join
from molframe.llm._runtime import ensure_checkpoint_dir


def test_stages_on_edges(spark, edge_docs, no_docs, tmp_path):
    for start in (edge_docs, no_docs):
        docs = start
        for name, stage in cp.STAGES:
            path = str(tmp_path / f"{name}-{start is edge_docs}")
            stage(spark, docs, "").write.parquet(path)
            docs = spark.read.parquet(path)
            if name != cp.STAGES[-1][0]:
                assert docs.columns == list(cp.COLUMNS)
        assert (docs.count() > 0) == (start is edge_docs)


def test_decisions(spark, sample_docs):
    before = {r.doc_id: r.text for r in sample_docs.collect()}
    told = cp.stage_language(spark, sample_docs, "")
    assert told.count() == len(before)  # all of them have letters
    one = cp.stage_near_duplicates(spark, sample_docs, "")
    groups = near_join.near_duplicates(sample_docs).collect()
    assert sorted(r.doc_id for r in one.select("doc_id").collect()) == sorted({r.group_id for r in groups})
    cut = {r.doc_id: r for r in cp.stage_repeats(spark, one, "").collect()}
    assert all(len(r.text) == r.n_chars > 0 and len(r.text) <= len(before[i]) for i, r in cut.items())
    safe = {r.doc_id: r.text for r in cp.stage_secrets(spark, sample_docs, "").collect()}
    assert safe.keys() == before.keys()
    changed = [i for i in before if safe[i] != before[i]]
    assert changed and all("-redacted>" in safe[i] for i in changed)


def test_language_without_labels(spark, edge_docs, sample_docs):
    """Nothing can be learned, so only texts without letters go."""
    plain = sample_docs.withColumn("lang", F.lit(None).cast("string"))
    assert cp.stage_language(spark, plain, "").count() == sample_docs.count()
    left = cp.stage_language(spark, edge_docs.withColumn("lang", F.lit(None).cast("string")), "").select("text").collect()
    assert len(left) == sum(any(c.isalpha() for c in r.text or "") for r in edge_docs.collect())


def test_language_label_is_that_of_the_text(spark, sample_docs):
    told = cp.stage_language(spark, sample_docs.withColumn("lang", F.when(F.col("doc_id") % 10 != 3, F.col("lang"))), "")
    both = told.alias("a").join(sample_docs.alias("b"), "doc_id").select("a.lang", F.col("b.lang").alias("truth")).collect()
    assert sum(r.lang == r.truth for r in both) > 0.98 * len(both) and all(r.lang for r in both)


def brute_cut(texts):
    """Texts without repeated windows, whole characters at the cuts."""
    bodies = [t.encode() for t in texts]
    seen = Counter(b[i : i + 200] for b in bodies for i in range(len(b) - 199))
    out = []
    for text, b in zip(texts, bodies):
        gone = set()
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone.update(range(i, i + 200))
        at, kept = 0, []
        for c in text:
            n = len(c.encode())
            if gone.isdisjoint(range(at, at + n)):
                kept.append(c)
            at += n
        out.append("".join(kept))
    return out


def test_repeats_keep_whole_characters(spark):
    """Marks of replaced characters that a text has stay; only what a cut splits goes."""
    passage = "漢é😀ß �" * 60
    made = ["a\ufffdb" + passage[k : k + 150] + "\ufffd tail " + chr(0x4E00 + k) * (k + 3) for k in range(6)] + ["\ufffd only here", passage[3:9]]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(made)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in cp.stage_repeats(spark, docs, "").collect()}
    assert got == {k: t for k, t in enumerate(brute_cut(made)) if t}


def test_repeats_stage_by_brute_force(spark, sample_docs):
    some = sample_docs.where("doc_id < 120")
    rows = some.select("doc_id", "text").collect()
    got = {r.doc_id: r.text for r in cp.stage_repeats(spark, some, "").collect()}
    assert got == {r.doc_id: t for r, t in zip(rows, brute_cut([r.text for r in rows])) if t}


def test_run(spark):
    folder = lambda: {p.name for p in Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")).glob("scratch-*")}
    ensure_checkpoint_dir(spark)
    before = folder()

    packed = cp.run(spark, "/root/testdata/sf0.001").toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048 and len(packed) > 0
    assert folder() == before
