"""Session settings."""

from __future__ import annotations

from gatetally.session import MIN_SPLITS, SETTINGS, SPLITS_PER_CORE, get_session


def test_settings(spark):
    for key, value in SETTINGS.items():
        assert spark.conf.get(key) == value
    cores = spark.sparkContext.defaultParallelism
    assert int(spark.conf.get(MIN_SPLITS)) == SPLITS_PER_CORE * cores


def test_given_number_of_splits_is_kept(spark):
    before = spark.conf.get(MIN_SPLITS)
    try:
        spark.conf.set(MIN_SPLITS, "3")
        assert get_session("tests").conf.get(MIN_SPLITS) == "3"
    finally:
        spark.conf.set(MIN_SPLITS, before)
