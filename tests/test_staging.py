"""Scratch tables belong to the job that makes them."""

import os

from sieve import staging


def test_a_job_removes_its_own_tables_only(spark):
    outer = staging.stage(spark.range(5), "outer")
    with staging.staged_job(spark) as paths:
        inner = staging.stage(spark.range(7), "inner")
        with staging.staged_job(spark) as nested:
            staging.stage(spark.range(2), "nested")
            assert len(nested) == 1
        assert len(paths) == 1 and inner.count() == 7
        path = paths[0].removeprefix("file:")
        assert os.path.isdir(path)
    assert not os.path.isdir(path) and outer.count() == 5


def test_a_staged_result_outlives_what_it_was_made_from(spark):
    made = []

    def work():
        first = staging.stage(spark.range(9), "first")
        made.append(first)
        return first.where("id > 3")

    result = staging.stage_result(spark, work, "result")
    assert sorted(r["id"] for r in result.collect()) == [4, 5, 6, 7, 8]
    assert not any(os.path.exists(f.removeprefix("file://")) for f in made[0].inputFiles()) and result.count() == 5


def test_an_error_still_releases(spark):
    seen = []
    try:
        with staging.staged_job(spark) as paths:
            staging.stage(spark.range(1), "lost")
            seen = list(paths)
            raise KeyError("x")
    except KeyError:
        pass
    assert seen and not os.path.isdir(seen[0].removeprefix("file:"))
