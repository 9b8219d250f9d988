"""The pipeline's stages against brute force on their own inputs."""

from types import SimpleNamespace

import helpers
import pytest

import corpus_pipeline
from logweave.llm import common, quality


def test_stages(spark, sf):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontamination", "mixing", "tokens"]
    docs, kept = common.table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        kept.append(docs)
        docs = common.written(stage(spark, docs, sf), f"test-{name}")
    inputs = dict(zip(names, kept, strict=True))
    assert all(frame.columns == kept[0].columns for frame in kept)
    good = quality.score(kept[0], quality.learn(kept[0], common.table(spark, sf, "labels")), ["doc_id"])
    assert {r["doc_id"] for r in inputs["near_dedup"].collect()} == {
        r["doc_id"] for r in good.collect() if r["score"] >= 0.5}
    near = helpers.brute_near([(r["doc_id"], r["text"]) for r in inputs["near_dedup"].collect()], percent=80)
    assert sorted(r["doc_id"] for r in inputs["decontamination"].collect()) == sorted(d for d, _, c in near if d == c)
    assert 0 < inputs["mixing"].count() <= inputs["decontamination"].count()
    assert docs.count() == inputs["tokens"].count()
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))


def test_near_dedup_stage_links_from_80_percent(spark, sf):
    """Copies with two words replaced: 0.818 and exactly 0.8 alike are one group, 0.798 is not."""
    rows = []
    for k, length in enumerate((104, 94, 93)):
        words = [f"d{k}w{x}" for x in range(length)]
        edited = [f"new{x}" if x in (20, 60) else w for x, w in enumerate(words)]
        rows += [helpers.row(2 * k, " ".join(words)), helpers.row(2 * k + 1, " ".join(edited))]
    kept = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, helpers.SCHEMA), sf)
    near = helpers.brute_near([(r[0], r[1]) for r in rows], percent=80)
    assert sorted(r["doc_id"] for r in kept.collect()) == [d for d, _, c in near if d == c] == [0, 2, 4, 5]


def test_empty_and_odd(spark, sf, odd, empty):
    for start in (empty, odd):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = common.written(stage(spark, docs, sf), f"odd-{name}")
        if start is empty:
            assert docs.count() == 0


def test_no_scratch_folder_is_an_error():
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(unset, "x")
