"""Close names: by what is left of them, and in a rebuild."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from actaflow.operators import matching
from actaflow.plans import queries


def test_names_that_share_their_words_are_not_compared_with_each_other(spark):
    names = spark.range(1, 40_000).select(F.concat(F.lit("EMPRESA "), "id").alias("base"), F.col("id").alias("pos"))
    start = time.monotonic()
    got = matching.similar_names(names.filter("pos % 10 <> 0"), names.filter("pos % 10 = 0"))
    found = {r.base: r.close for r in got.filter("base in ('EMPRESA 12345', 'EMPRESA 39999', 'EMPRESA 7')").collect()}
    assert found["EMPRESA 12345"] == "EMPRESA 12340" and found["EMPRESA 39999"] == "EMPRESA 39990" and found["EMPRESA 7"] == "EMPRESA 70"
    assert time.monotonic() - start < 60


@pytest.mark.parametrize("cutoff", [90, 85, 60])
def test_all_close_pairs_of_short_names_are_found(spark, cutoff):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ABC") for _ in range(rng.randrange(1, 19))) for _ in range(120)})
    asked, watched = words[::2], words[1::2]
    pairs = spark.createDataFrame([(a, b, i) for a in asked for i, b in enumerate(watched)], "base string, close string, pos long")
    best = pairs.withColumn("score", matching.indel_ratio(F.col("base"), F.col("close"))).filter(F.col("score") >= cutoff).groupBy("base").agg(F.min_by(F.struct("close", "score"), F.struct(-F.col("score"), "pos")).alias("b"))
    expected = {r.base: (r.close, round(r.score, 6)) for r in best.select("base", "b.*").collect()}
    got = matching.similar_names(spark.createDataFrame([(a,) for a in asked], "base string"), spark.createDataFrame([(b, i) for i, b in enumerate(watched)], "base string, pos long"), cutoff)
    assert {r.base: (r.close, round(r.score, 6)) for r in got.collect()} == expected != {}


def test_the_registered_rebuild_proposes_close_names(spark, sf_dir):
    _, out = queries._rebuilt(spark, sf_dir)
    assert out["notices"].filter("reason like 'similar name%' and kept_as = 'review'").count() > 0
