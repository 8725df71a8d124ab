"""Queries over the announcements read what they use."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from actaflow.functions.text import one_space, plain
from actaflow.plans import queries
from actaflow.plans.queries import Gazette


def test_acts_alone_are_those_of_the_whole_reading(spark, sf_dir):
    whole, acts = Gazette(spark, sf_dir), Gazette(spark, sf_dir, keep=True, registry=False)
    columns = ["doc_id", "num", "firm", F.to_json("acts").alias("acts")]
    assert sorted(acts.full.select(*columns).collect()) == sorted(whole.full.select(*columns).collect())
    assert sorted(acts.keyed().collect()) == sorted(whole.announcements.select("doc_id", "num", "firm_key").collect())


@pytest.mark.parametrize("name", ["q_detect", "q_eval", "q_signal_hits"])
def test_sheets_and_dates_are_not_read(spark, sf_dir, monkeypatch, name):
    def read(*_):
        raise AssertionError("registry data was read")

    monkeypatch.setattr(queries, "with_registry", read)
    assert queries.QUERIES[name](spark, sf_dir).columns


def test_spaces(spark):
    texts = ["a b", " a  b ", "a\tb", "a\u00a0b", "a \u00a0 b", "\u2003", "", None, "a\n\nb", "Uno, S. L."]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.trim(F.regexp_replace("t", r"(?U)\s+", " "))
    flat = F.trim(F.regexp_replace(F.upper("t"), "[^A-Z0-9]+", " "))
    for r in rows.select("t", one_space(F.col("t")).alias("a"), old.alias("b"), plain(F.translate("t", "\u00a0\u2003", "..")).alias("c"), flat.alias("d")).collect():
        assert (r.a, r.c) == (r.b, r.d)
