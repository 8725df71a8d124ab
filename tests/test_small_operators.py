"""Operators that no other test exercises."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import functions as F

from actaflow.operators import corpus, discovery, positions, process, record, tables
from actaflow.plans import queries, synth
from actaflow.sources import gazette, lists

EVENT = "company_id long, day date, event_id long, holder string, role string, label string, kind string"


def test_naive_positions_and_reordered_names(spark):
    d = lambda n: datetime.date(2024, 1, n)
    rows = [
        (1, d(1), 1, "RUIZ ANA", "attorney", "Apoderado", "appointment"),
        (1, d(2), 2, "ANA RUIZ", "attorney", "Apoderado", "removal"),  # the same person in another order
        (1, d(3), 3, "GIL LUIS", "attorney", "Apoderado", "appointment"),
        (1, d(3), 4, "GIL LUIS", "attorney", "Apoderado", "removal"),
    ]
    events = spark.createDataFrame(rows, EVENT)
    assert [r.event_id for r in positions.naive_positions(events).collect()] == [1]
    assert positions.positions_held(events).collect() == []
    assert tuple(positions.reordered_names(events).first()) == (3, 1, 2)


def test_group_addresses_keep_the_first_of_each_group(spark):
    rows = [(f"F{i}", f"L{i % 5}", 1 if i < 12 else 2) for i in range(16)] + [("X", "L0", None)]
    table = spark.createDataFrame(rows, "firm_key string, label string, group_id long")
    sites = table.select("firm_key", F.struct("label", F.lit("T").alias("town")).alias("site"))
    found = corpus.group_addresses(sites, table.filter("group_id is not null").select("firm_key", "group_id"), 2)
    assert sorted((r.group_id, r["rank"], r.label, r.companies) for r in found.collect()) == [(1, 1, "L0", 3), (1, 2, "L1", 3), (2, 1, "L0", 1), (2, 2, "L2", 1)]


def test_noise_file_and_tables_by_part(spark, tmp_path):
    (tmp_path / "noise.json").write_text(json.dumps({"CALLE UNO 1 (MADRID)": 7, "CALLE DOS 2 (LUGO)": 1}))
    assert {(r.label, r.n) for r in lists.read_noise(spark, str(tmp_path / "noise.json")).collect()} == {("CALLE UNO 1 (MADRID)", 7), ("CALLE DOS 2 (LUGO)", 1)}
    path, table = str(tmp_path / "t"), lambda rows: spark.createDataFrame(rows, "year int, v string")
    lists.write_table(table([(2023, "a"), (2024, "b")]), path, "year")
    lists.write_table(table([(2024, "c")]), path, "year")
    assert {(r.year, r.v) for r in spark.read.parquet(path).collect()} == {(2023, "a"), (2024, "c")}
    lists.write_table(table([(2025, "d")]), path)
    assert [r.v for r in spark.read.parquet(path).collect()] == ["d"]


def _acts(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, num long, seq int, act_type string, detail string, fact_day date")


def test_copies_of_a_site_are_compared_once(spark):
    day = datetime.date(2024, 1, 1)
    seen = discovery.registered_sites(_acts(spark, [("D", i, 1, "address_change", f"CL EJEMPLO {i % 2} (MADRID)", day) for i in range(40)]))
    known = discovery.watched_sites(spark.createDataFrame([(i, i % 3, f"CALLE EJEMPLO {i % 3}", "MADRID") for i in range(1, 31)], "pos long, group_id long, street string, city string"))
    assert {(r.site.label, r.known.label) for r in discovery.site_pairs(seen, known).collect()} == {(f"EJEMPLO {i} (MADRID)",) * 2 for i in (0, 1)}
    assert discovery.site_pairs(seen, known).count() == 2
    assert {(r.num, r.group_id, r.label) for r in discovery.at_watched_sites(seen, known).collect()} == {(i, 1 if i % 2 else 0, f"EJEMPLO {i % 2} (MADRID)") for i in range(40)}


def test_the_last_of_two_values_of_a_day_holds(spark):
    day, said = datetime.date(2024, 1, 1), "Capital: 1,00 Euros. Resultante Suscrito: {},00 Euros"
    acts = _acts(spark, [("D", num, 1, "capital_increase", said.format(euros), day) for num, euros in ((1, 10), (3, 20), (5, 10))])
    links = acts.select("doc_id", "num", F.lit(7).cast("long").alias("company_id"), "fact_day")
    values = process.derive_values(acts, links)
    assert values.count() == 2
    assert [(r.value, r.num) for r in record.record_now(values, links).collect()] == [("10.00", 5)]


def test_all_watched_companies_are_seeds_of_the_closure(spark, tmp_path):
    """Company 10 is above the half and owns company 6 (6 * 7 modulo 16)."""
    e = spark.createDataFrame([(6 * i, 6, "view", datetime.datetime(2024, 1, 1), 1.0, '{"k": 1}') for i in range(3)] + [(1, u, "view", datetime.datetime(2024, 1, 1), 1.0, '{"k": 1}') for u in (10, 15)], "event_id long, user_id long, event_type string, ts timestamp, value double, props string")
    e.write.parquet(str(tmp_path / "events.parquet"))
    found = {(r.seeds, r.node, r.depth) for r in queries.q_closure(spark, str(tmp_path)).collect()}
    assert found == {("all", "EMPRESA 6 SL", 1)}


def test_tasks_follow_the_rows_of_a_scan(spark):
    assert tables.spread(spark.range(0, 1000, 1, 2), 100).rdd.getNumPartitions() == 10
    assert tables.spread(spark.range(0, 1000, 1, 12), 100).rdd.getNumPartitions() == 12
    assert tables.spread(spark.range(0, 10, 1, 2), 100).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_a_document_in_parts_is_read_whole(spark, tmp_path):
    rows = [("GZ-A-20240101-00", i, "MADRID", datetime.date(2024, 1, 1), f"{i} - UNO {i} SL", "Nombramientos. Auditor: PERSONA ALFA.") for i in range(10)]
    a = spark.createDataFrame(rows, "doc_id string, num long, province string, day date, header string, body string")
    parts = synth.documents(a, most=3)
    assert parts.count() > 1 and max(len(r.texto.p) for r in parts.collect()) < 20
    parts.write.format("xml").option("rootTag", "documentos").option("rowTag", "documento").save(str(tmp_path / "A"))
    read = gazette.read_announcements(gazette.read_documents(spark, str(tmp_path / "A")))
    assert sorted((r.num, r.firm, len(r.acts)) for r in read.collect()) == [(i, f"UNO {i} SL", 1) for i in range(10)]
