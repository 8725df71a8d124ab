"""Positions with state against the batch rule, and batches that are written once."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from actaflow.operators.positions import positions_held
from actaflow.streaming import ingest, positions

EVENT = "company_id long, day date, event_id long, holder string, role string, label string, kind string"
LABELS = {"sole_director": "Adm. Unico", "joint_several_director": "Adm. Solid.", "board_member": "Consejero", "auditor": "Auditor", "attorney": "Apoderado", "secretary": "Secretario"}


def events(seed, n=260):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        role = rng.choice(list(LABELS))
        day = datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randint(0, 40))
        holder = rng.choice(["ANA RUIZ", "RUIZ ANA", "LUIS GIL", "EVA MAS", "JUAN PAZ"])
        out.append((rng.randint(1, 4), day, i, holder, role, LABELS[role], rng.choice(["appointment", "appointment", "removal", "reelection"])))
    return out


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(positions.ROCKSDB[0])
    spark.conf.set(*positions.ROCKSDB)
    yield spark
    spark.conf.set(positions.ROCKSDB[0], before)


def run(spark, tmp_path, rows, parts, late="36500 days"):
    """The stream over files of ``rows``, one file a batch in the order given."""
    source = tmp_path / "source"
    for i in range(parts):
        spark.createDataFrame(rows[i::parts] if late.startswith("36500") else rows[i * len(rows) // parts : (i + 1) * len(rows) // parts], EVENT).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(source))
    ingest.run_available(positions.position_changes(stream, late), str(tmp_path / "out"), "update")
    return positions.held_now(ingest.read_batches(spark, str(tmp_path / "out"), positions.CHANGE))


def keys(df):
    return sorted((r.company_id, r.event_id, r.role, r.holder) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival_ends_as_the_batch_does(rocks, tmp_path, seed):
    rows = events(seed)
    expected = keys(positions_held(rocks.createDataFrame(rows, EVENT)))
    random.Random(seed).shuffle(rows)
    assert keys(run(rocks, tmp_path, rows + rows[:20], 3)) == expected != []


def test_days_behind_the_watermark_are_folded(rocks, tmp_path):
    rows = sorted(events(7), key=lambda r: r[1:3])
    assert keys(run(rocks, tmp_path, rows, 4, "1 days")) == keys(positions_held(rocks.createDataFrame(rows, EVENT)))


def test_a_run_killed_between_rows_and_mark_changes_nothing(spark, tmp_path):
    source, folder, schema = str(tmp_path / "in"), str(tmp_path / "out"), "doc_id string, n long"
    spark.range(5).selectExpr("concat('D', id) doc_id", "id n").coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    done = ingest.batch_writer(folder)

    def killed_before_mark(batch, number):
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/rows/{number}")
        raise RuntimeError("killed")

    def killed_after_mark(batch, number):
        done(batch, number)
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        ingest.run_available(stream(), folder, after=killed_before_mark)
    assert ingest.read_batches(spark, folder, schema).count() == 0 and ingest.batches_done(spark, folder).count() == 0
    with pytest.raises(Exception, match="killed"):
        ingest.run_available(stream(), folder, after=killed_after_mark)
    assert ingest.read_batches(spark, folder, schema).count() == 5
    ingest.run_available(stream(), folder)
    assert [(r.batch, r.n_rows) for r in ingest.batches_done(spark, folder).collect()] == [(0, 5)]
    # more files, one of them with documents that were there before
    spark.range(3, 8).selectExpr("concat('D', id) doc_id", "id + 100 n").coalesce(1).write.mode("append").parquet(source)
    ingest.run_available(stream(), folder)
    ingest.run_available(stream(), folder)
    rows = ingest.read_batches(spark, folder, schema)
    assert rows.count() == 10 and {(r.doc_id, r.n) for r in ingest.latest_rows(rows, ["doc_id"]).collect()} == {(f"D{i}", i if i < 3 else i + 100) for i in range(8)}


def test_documents_that_come_again_replace_the_old_ones(spark, tmp_path):
    from tests.test_sources import A

    landed, folder = tmp_path / "landed", str(tmp_path / "out")
    landed.mkdir()
    (landed / "a.xml").write_text(A)
    (landed / "b.xml").write_text(A.replace("GZ-A-2026-1-28", "GZ-A-2026-1-29").replace("<titulo>MADRID</titulo>", ""))
    ingest.ingest_documents(spark, str(landed), folder)
    out = ingest.ingested(spark, folder)
    assert {(r.num, r.sheet) for r in out["announcements"].collect()} == {(101, "M 55"), (-1, None)}
    assert [(r.status, r.n_documents, r.errors) for r in out["days"].collect()] == [("failed", 1, ["GZ-A-2026-1-29: missing <titulo>"])]
    (landed / "c.xml").write_text(A.replace("101 - UNO", "102 - UNO").replace("H M 55", "H M 56"))
    (landed / "d.xml").write_text(A.replace("GZ-A-2026-1-28", "GZ-A-2026-1-29").replace("101 - UNO", "9 - UNO"))
    ingest.ingest_documents(spark, str(landed), folder)
    ingest.ingest_documents(spark, str(landed), folder)
    out = ingest.ingested(spark, folder)
    assert sorted((r.doc_id[-2:], r.num, r.sheet) for r in out["announcements"].collect() if r.num > 0) == [("28", 102, "M 56"), ("29", 9, "M 55")]
    assert [(r.status, r.n_documents) for r in out["days"].collect()] == [("published", 2)]
