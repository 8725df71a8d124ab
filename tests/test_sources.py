"""Readers on invented files, and the streams."""

from __future__ import annotations

import json
import os
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from actaflow.sources import gazette, lists, report
from actaflow.streaming import gazette as streams

A = """<?xml version="1.0" encoding="UTF-8"?><documento fecha_actualizacion="x"><metadatos><identificador>GZ-A-2026-1-28</identificador><titulo>MADRID</titulo><diario_numero>1</diario_numero><fecha_publicacion>20260105</fecha_publicacion></metadatos>
<texto><p class="articulo">101 - UNO EJEMPLO SL.</p><p class="parrafo">Constitución. Domicilio: CL UNO 3 (MADRID). Capital: 3.000,00 Euros.</p><p class="parrafo">Datos registrales. S 8 , H M 55, I/A 1 ( 2.01.26).</p>
<p class="centro_redonda">Texto</p><p class="articulo"> - DOS SA</p><p class="parrafo">Nombramientos. Adm. Unico: PERSONA UNO.</p></texto></documento>"""
B = """<documento><metadatos><identificador>GZ-B-2026-1-18</identificador><titulo>GRANADA</titulo><diario_numero>1</diario_numero><fecha_publicacion>20260105</fecha_publicacion></metadatos>
<texto><p class="centro_redonda">Depósitos de proyectos de fusión.</p><p class="articulo">7 - UNO SL; DOS SA (03/02/2026)</p><p class="parrafo">Absorbidas: DOS SA.</p><p class="articulo">sin número ni guion</p><p class="parrafo">perdido</p></texto></documento>"""


def test_documents(spark, tmp_path):
    for name, text in (("a", A), ("b", B)):
        (tmp_path / f"{name}.xml").write_text(text)
    docs = gazette.read_documents(spark, str(tmp_path))
    assert {r.doc_id: (r.section, r.province, r.day, r.problem) for r in docs.collect()} == {"GZ-A-2026-1-28": ("A", "MADRID", date(2026, 1, 5), None), "GZ-B-2026-1-18": ("B", "GRANADA", date(2026, 1, 5), None)}
    got = {(r.doc_id[3], r.num): r for r in gazette.read_announcements(docs).collect()}
    assert set(got) == {("A", 101), ("A", -1), ("B", 7)}
    uno = got["A", 101]
    assert uno.firm == "UNO EJEMPLO SL" and uno.sheet == "M 55" and uno.inscription_date == date(2026, 1, 2) and uno.acts[0].act_type == "incorporation"
    both = got["B", 7]
    assert both.firm == "UNO SL" and both.other_companies == ["DOS SA"] and both.acts[0].act_type == "merger_project" and both.acts[0].detail.startswith("Listed with: DOS SA. ")


def test_broken_documents_are_told(spark, tmp_path):
    (tmp_path / "c.xml").write_text(A.replace("<titulo>MADRID</titulo>", ""))
    assert [r.problem for r in gazette.read_documents(spark, str(tmp_path)).collect()] == ["missing <titulo>"]


def test_index(spark, tmp_path):
    item = {"identificador": "GZ-A-1", "titulo": "LUGO", "url_xml": "https://h.example/x", "url_pdf": {"texto": "https://h.example/p"}}
    index = {"data": {"sumario": {"metadatos": {"fecha_publicacion": "20260105"}, "diario": {"seccion": [{"codigo": "A", "item": [item, {**item, "identificador": "GZ-A-99", "titulo": "ÍNDICE ALFABÉTICO"}]}, {"codigo": "B", "item": {**item, "identificador": "GZ-B-1", "url_pdf": "https://h.example/q"}}, {"codigo": "C", "apartado": []}]}}}}
    (tmp_path / "s.json").write_text(json.dumps(index))
    got = {r.doc_id: (r.section, r.pdf_url, r.day) for r in gazette.read_index(spark, str(tmp_path), host="h.example").collect()}
    assert got == {"GZ-A-1": ("A", "https://h.example/p", date(2026, 1, 5)), "GZ-B-1": ("B", "https://h.example/q", date(2026, 1, 5))}
    with pytest.raises(Exception, match="not an address"):
        gazette.read_index(spark, str(tmp_path), host="other.example").collect()


def test_days(spark):
    files = spark.createDataFrame([(date(2026, 1, 1), "published", None), (date(2026, 1, 1), "failed", "e2"), (date(2026, 1, 2), "published", None), (date(2026, 1, 3), "no_gazette", None)], "day date, status string, error string")
    got = gazette.day_results(files)
    assert {r.day.day: r.status for r in got.collect()} == {1: "failed", 2: "published", 3: "no_gazette"}
    assert sorted(r.day.day for r in gazette.days_to_ask(spark, "2026-01-01", "2026-01-04", got).collect()) == [1, 3, 4]
    assert [(str(r.first), str(r.last)) for r in gazette.year_ranges(spark, "2024-05-01", "2025-02-01").collect()] == [("2025-01-01", "2025-02-01"), ("2024-05-01", "2024-12-31")]


def test_watchlist(spark, tmp_path):
    p = tmp_path / "w.csv"
    p.write_text("﻿group,name,capital,head,incorporated,joined\nG, Uno SL ,3000.5,yes,2020-01-02,2021\n,Dos SA,,,,\nG,UNO S.L.,1,,,\n", encoding="utf-8")
    got = {r["name"]: r for r in lists.read_watchlist(spark, str(p)).collect()}
    assert set(got) == {"Uno SL", "Dos SA"} and got["Uno SL"].capital == Decimal("3000.50") and got["Uno SL"]["head"] and got["Dos SA"].group == "Dos SA" and got["Uno SL"].joined == 2021
    p.write_text("name,capital\nUno,abc\n")
    with pytest.raises(Exception, match="bad capital"):
        lists.read_watchlist(spark, str(p)).collect()


def test_small_lists(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"Acmé Uno": "G", "beta": "H"}')
    groups = spark.createDataFrame([("G", 1), ("H", 2)], "label string, group_id long")
    assert {r.token: r.group_id for r in lists.read_tokens(spark, str(tmp_path / "t.json"), groups).collect()} == {"ACME UNO": 1, "BETA": 2}
    with pytest.raises(Exception, match="unknown group"):
        lists.read_tokens(spark, str(tmp_path / "t.json"), groups.limit(1)).collect()
    (tmp_path / "e.json").write_text('{"signals": [{"truth": "relations_or_shared_officers", "reason": "token", "precision": 0.7}, {"truth": "x", "reason": "mention", "precision": 0.1}]}')
    assert lists.read_precisions(spark, str(tmp_path / "e.json")) == {"mention": 1.0, "address": 0.5, "token": 0.7, "person": 0.25}
    lists.write_words(spark.createDataFrame([("B",), ("A",)], "word string"), str(tmp_path / "w"), "rule")
    assert [r.word for r in lists.read_words(spark, str(tmp_path / "w")).collect()] == ["A", "B"]


def test_report_hides_details(spark):
    rows = spark.createDataFrame([("G", "UNO SL", date(2026, 1, 1), "appointment", "board", "medium", "Adm: PERSONA|UNO", "d", 1, 1)], "label string, firm string, day date, act_type string, scope string, priority string, text string, doc_id string, num long, seq int")
    leads = spark.createDataFrame([(1, 1, "L SL", "token", 0.5, "first")], "lead_id long, group_id long, firm string, reason string, score double, tier string")
    props = spark.createDataFrame([(1, "name", "a", "b", "registry")], "company_id long, field string, held string, proposed string, why string")
    shown = report.render(rows, leads, props, "T")
    assert "PERSONA/UNO" in shown and "| G |" not in shown and "## G" in shown and "L SL" in shown
    assert "PERSONA" not in report.render(rows, leads, props, "T", details=False)


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("d", i, f"2026-01-0{1 + i % 3} 10:00:00", "Disolución. Voluntaria. Nombramientos. Apoderado: PERSONA UNO.") for i in range(6)]
    spark.createDataFrame([*rows, rows[0]], "doc_id string, num long, published string, raw_text string").withColumn("published", F.to_timestamp("published")).write.parquet(source)
    stream = spark.readStream.schema("doc_id string, num long, published timestamp, raw_text string").parquet(source)
    q = streams.act_tally(stream, "1 hour").writeStream.outputMode("append").format("memory").queryName("tally").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.day.day, r.act_type): r.n for r in spark.table("tally").collect()}
    assert got and set(got.values()) == {2} and {t for _, t in got} == {"dissolution", "appointment"}


def test_entry_contract(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isdir(sf_dir)


def test_rebuild_from_files(spark, tmp_path):
    """A folder of documents and a watchlist, in one go."""
    from actaflow.plans import commands

    (tmp_path / "docs").mkdir()
    for name, text in (("a", A), ("b", B)):
        (tmp_path / "docs" / f"{name}.xml").write_text(text)
    (tmp_path / "w.csv").write_text("group,name\nG,Uno Ejemplo SL\nG,Dos SA\n")
    out = commands.run_command(spark, str(tmp_path / "docs"), str(tmp_path / "w.csv"))
    assert sorted((r.num, r.kept_as, r.via) for r in out["notices"].collect()) == [(-1, "watched", "name"), (7, "candidate", "none"), (101, "watched", "sheet")]
    assert [(r.province, r.sheet) for r in out["sheets"].collect()] == [("MADRID", "M 55")]
    assert [(r.role, r.holder) for r in out["positions"].collect()] == [("sole_director", "PERSONA UNO")]
    record = {r.field: r.value for r in out["record"].collect()}
    assert record["address"] == "CL UNO 3" and record["city"] == "MADRID" and record["capital"] == "3000.00"
    assert [(r.firm, r.reason, r.state) for r in out["leads"].collect()] == [("UNO SL", "mention", "open")]
    assert {r.kept_as: r.n for r in out["tallies"].collect()} == {"watched": 2, "candidate": 1}
    counted = commands.stats(out["notices"], out["acts"])["acts"]
    assert counted.filter("level = 3").first().n == 3
