"""I11 end to end: prepare -> model -> recommend -> report, on sf0.001."""

from __future__ import annotations

import pytest

from cartwise.operators import sequences as seq
from cartwise.plans import pipeline as pl
from cartwise.sources import versions
from cartwise.plans.recommend import BANNER, DETAILS_TITLE, HEADER_LABELS

SF = "/root/testdata/sf0.001"


def test_run_writes_every_step(spark, tmp_path):
    out = pl.run(spark, SF, str(tmp_path / "res"), sample_size=2, product_number=3,
                 select_best=True)
    assert {"complete_data", "classifier_data", "avg_score_per_product", "cv_scores",
            "encoders", "classifier", "unlabeled_data", "columns", "report"} <= set(out)
    wide = spark.read.parquet(out["complete_data"])
    assert wide.count() == 6144  # FIXTURES.md: joined size at sf0.001
    cv = spark.read.parquet(out["cv_scores"]).collect()
    assert len(cv) == 30
    lines = spark.read.parquet(out["report"]).orderBy("customer_unique_id",
                                                      "line_no").collect()
    assert lines and lines[0].line.startswith(HEADER_LABELS[0])
    assert all(len(r.line) >= BANNER or r.line == "" or r.line.startswith(
        ("Last", "Predicted", "Product", "Price", "Estimated", "Avg")) for r in lines)
    per = {}
    for r in lines:
        per.setdefault(r.customer_unique_id, []).append(r.line_no)
    for nos in per.values():
        assert nos == list(range(len(nos)))  # contiguous line numbers


def test_best_inverse_reg(spark):
    cv = spark.createDataFrame([(1.0, 0, 0, 0.5), (0.1, 0, 0, 0.7), (0.01, 0, 0, 0.7)],
                               "inverse_reg double, repeat int, fold int, accuracy double")
    assert pl.best_inverse_reg(cv) == 0.1


def test_recommend_runs_from_saved_files_only(spark, tmp_path):
    """The third job in a session of its own, which has nothing in memory."""
    out = str(tmp_path / "res")
    pl.run(spark, SF, out, sample_size=2, product_number=3)
    first = spark.read.parquet(pl.outputs(spark, out)["report"]).collect()
    other = spark.newSession()
    art = pl.load_artifacts(other, out)
    assert art.spec == seq.PIPELINE_SPEC
    assert spark.read.parquet(pl.outputs(spark, out)["unlabeled_data"]).count() == \
        pl.usable_rows(art.data, art.spec).count()
    path = pl.recommend(other, out, sample_size=2, product_number=3, verbose=True)["report"]
    second = other.read.parquet(path).collect()
    lines = {(r.customer_unique_id, r.line) for r in second}
    assert {(r.customer_unique_id, r.line) for r in first} <= lines
    details = [r for r in second if r.line == DETAILS_TITLE]
    people = {r.customer_unique_id for r in second}
    assert {r.customer_unique_id for r in details} == people
    assert len(second) == len(first) + len(people) * (len(art.data.columns) + 2)
    per = {}
    for r in second:
        per.setdefault(r.customer_unique_id, []).append(r.line_no)
    assert all(sorted(nos) == list(range(len(nos))) for nos in per.values())


def test_a_killed_step_leaves_the_version_before_it(spark, tmp_path, monkeypatch):
    """prepare dies between two writes: readers and later jobs see the old version
    whole; the same call again finishes it; steps that are done are skipped."""
    out = str(tmp_path / "res")
    before = pl.run(spark, SF, out, sample_size=2, product_number=3)
    assert pl.outputs(spark, out) == before
    t = pl.retail_tables(spark, SF)
    real, calls = pl._put, []

    def dies(df, run_dir, name):
        calls.append(name)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return real(df, run_dir, name)

    monkeypatch.setattr(pl, "_put", dies)
    with pytest.raises(KeyboardInterrupt):
        pl.prepare(spark, t, out, n=36)
    assert pl.outputs(spark, out) == before
    assert spark.read.parquet(pl.outputs(spark, out)["complete_data"]).count() == 6144
    assert pl.load_artifacts(spark, out).model.numClasses > 1

    calls.clear()
    assert pl.run(spark, SF, out, sample_size=2, product_number=3) == before    # nothing written
    assert calls == []
    monkeypatch.setattr(pl, "_put", real)
    after = pl.prepare(spark, t, out, n=36)
    assert set(after) == set(before) - {"cv_scores", "classifier", "report"}
    assert not set(after.values()) & set(before.values())
    now = pl.outputs(spark, out)
    assert {k: now[k] for k in after} == after and now["classifier"] == before["classifier"]
    # the model still goes with the files it was trained on
    assert pl.load_artifacts(spark, out).train.count() == \
        pl.usable_training(spark.read.parquet(before["predictor_table"]), seq.PIPELINE_SPEC).count()
    gone = versions.prune(spark, out, pl.STEPS)
    assert len(gone) == 1                                       # what the killed run wrote
    assert pl.outputs(spark, out) == now and spark.read.parquet(now["report"]).count()


def test_jobs_need_the_one_before(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        pl.model(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        pl.recommend(spark, str(tmp_path))
    assert pl.outputs(spark, str(tmp_path)) == {}
