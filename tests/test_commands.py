"""Whole commands and the steps that they are made of."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from actaflow.operators import corpus, discovery, graph, matching, measure, positions, process, timeline
from actaflow.plans import commands, queries, synth
from actaflow.sources import gazette, lists, report

D = date(2020, 1, 1)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in (columns or df.columns)) for r in df.collect())


def test_cleared_tables(spark):
    t = {
        "values": spark.createDataFrame([(1, "watchlist"), (2, "registry")], "id long, source string"),
        "sheets": spark.createDataFrame([(1, "listed"), (2, "name")], "id long, how string"),
        "days": spark.createDataFrame([(1, "no_gazette"), (2, "published"), (3, "failed")], "id long, status string"),
        "notices": spark.range(3),
        "watched": spark.range(2),
    }
    assert {k: [r.id for r in v.collect()] for k, v in process.clear_derived(t).items()} == {"values": [1], "sheets": [1], "days": [1], "notices": [], "watched": [0, 1]}


def test_unread_documents_and_group_labels(spark):
    docs = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "doc_id string, n int")
    assert {r.n for r in process.unread(docs, docs.filter("doc_id = 'a'")).collect()} == {2, 3}
    assert process.unread(docs.limit(0), docs).count() == 0
    m = spark.createDataFrame([(1, "G"), (1, "G"), (2, "H"), (None, "X")], "group_id long, group string")
    assert rows(process.group_labels(m)) == [(1, "G"), (2, "H")]


def test_members_are_found_in_their_group(spark):
    m = spark.createDataFrame([(1, 10, "Uno Ejemplo SL"), (1, 11, "UNO EJEMPLO SA"), (2, 20, "Uno Ejemplo SL"), (1, 12, "ABC SL")], "group_id long, company_id long, name string")
    asked = spark.createDataFrame([(1, "UNO EJEMPLO, S.A."), (1, "Uno Ejemplo SLL"), (2, "uno ejemplo"), (3, "Uno Ejemplo SL"), (1, "ABC"), (1, ""), (1, None)], "group_id long, name string")
    got = [(r.group_id, r.name, r.found) for r in process.find_members(asked, process.group_keys(m)).collect()]
    assert sorted(got, key=str) == sorted([(1, "UNO EJEMPLO, S.A.", 11), (1, "Uno Ejemplo SLL", 10), (2, "uno ejemplo", 20), (3, "Uno Ejemplo SL", None), (1, "ABC", None), (1, "", None), (1, None, None)], key=str)


def test_watched_lookup_has_no_guard(spark):
    w = spark.createDataFrame([(1, "UNO SL"), (2, "DOS SL")], "company_id long, name_key string")
    sheets = spark.createDataFrame([("M", "1", 2)], "province string, sheet string, company_id long")
    n = spark.createDataFrame([("Uno, S.L.", "M", "1"), ("Uno, S.L.", "M", None), ("Otra SL", "M", "9"), (None, "M", "1")], "firm string, province string, sheet string")
    assert sorted((str(r.firm), str(r.sheet), r.watched_id or 0) for r in matching.watched_lookup(n, w, sheets).collect()) == [("None", "1", 2), ("Otra SL", "9", 0), ("Uno, S.L.", "1", 2), ("Uno, S.L.", "None", 1)]


def test_earlier_hands(spark):
    f = [
        (1, date(2020, 5, 1), 5, "owner", True, "G"), (1, date(2019, 1, 1), 1, "owner", False, "X"), (1, date(2018, 1, 1), 0, "owner", False, "Y"), (1, date(2017, 1, 1), 0, "incorporated", False, ""),
        (1, date(2020, 5, 20), 6, "body_out", False, "C"), (2, date(2020, 1, 1), 1, "owner", False, "X"), (3, date(2020, 1, 1), 1, "body_in", True, "P"), (3, date(2021, 1, 1), 2, "owner", False, "X"),
    ]
    facts = spark.createDataFrame(f, "company_id long, day date, at long, kind string, by_group boolean, note string")
    got = {r.company_id: r.codes for r in timeline.earlier_hands(facts).collect()}
    assert got == {1: ["outside_owner:2018-01-01", "outside_owner:2019-01-01", "founded_before:2017-01-01", "handover:19d"], 3: []}


def test_ties_to_a_group(spark):
    slots = spark.createDataFrame([(1, 7, D, 1, "owned_by"), (2, 7, D, 1, "names")], "company_id long, group_id long, day date, at long, kind string")
    bodies = spark.createDataFrame([(1, 7, date(2019, 1, 1), 0, "board_member", True), (3, 7, D, 1, "sole_director", True), (4, 7, D, 1, "sole_director", False)], "company_id long, group_id long, day date, at long, role string, opens boolean")
    t = timeline.tie_to_group(slots, bodies)
    assert rows(t.select("company_id", "tie", timeline.belongs(F.col("tie")).alias("b"))) == [(1, "owned_by", True), (3, "run_by", True), (4, "on_body", False)]


def test_landed_files_and_the_log(spark, tmp_path):
    urls = spark.createDataFrame([("https://h.example/a/doc.xml?id=1",), ("https://h.example/" + "x" * 200,)], "u string")
    short, long_one = (r.p for r in urls.select(gazette.landed_path(F.col("u")).alias("p")).collect())
    assert short.startswith(short.split(".")[-1][:2] + "/doc.xml_id_1.") and len(long_one) == 3 + 80 + 1 + 16
    (tmp_path / short[:2]).mkdir()
    (tmp_path / short).write_bytes(b"<x/>")
    landed = gazette.read_landed(spark, str(tmp_path))
    assert [(r.path, bytes(r.bytes)) for r in landed.collect()] == [(short, b"<x/>")]
    index = spark.createDataFrame([(D, "d1", "https://h.example/a/doc.xml?id=1"), (date(2020, 1, 2), "d2", "https://h.example/zz"), (date(2020, 1, 3), "d3", "https://h.example/yy")], "day date, doc_id string, xml_url string")
    refused = spark.createDataFrame([("d2", "HTTP 500")], "doc_id string, error string")
    results = gazette.day_results(gazette.landed_days(index, landed, refused))
    assert {r.day.day: (r.status, r.errors) for r in results.collect()} == {1: ("published", []), 2: ("failed", ["d2: HTTP 500"]), 3: ("not_cached", [])}
    log = spark.createDataFrame([(D, "failed", 0, ["e"]), (date(2019, 12, 31), "published", 4, []), (date(2020, 1, 3), "no_gazette", 0, [])], "day date, status string, n_documents long, errors array<string>")
    after = gazette.record_days(log, results)
    assert {(r.day, r.status) for r in after.collect()} == {(D, "published"), (date(2020, 1, 2), "failed"), (date(2019, 12, 31), "published"), (date(2020, 1, 3), "no_gazette")}
    assert rows(gazette.plan_range(spark, "2019-12-31", "2020-01-02", after)) == [(date(2019, 12, 31), False), (D, False), (date(2020, 1, 2), True)]
    assert all(r.asked for r in gazette.plan_range(spark, "2019-12-31", "2020-01-02", after, again=True).collect())


def test_range_run_skips_published_days_and_fails_whole_ones(spark):
    def doc(name, day, problem=None):
        p = [{"_class": "articulo", "_VALUE": "1 - UNO EJEMPLO SL."}, {"_class": "parrafo", "_VALUE": "Disolución. Voluntaria. Datos registrales. S 8 , H M 5, I/A 3 (2.01.20)."}]
        return (name, "A", "MADRID", day, 1, p, "", problem)

    docs = spark.createDataFrame(
        [doc("d1", D), doc("d2", date(2020, 1, 2)), doc("d3", date(2020, 1, 3)), doc("d4", date(2020, 1, 3), "missing <titulo>")],
        "doc_id string, section string, province string, day date, issue_no int, paragraphs array<struct<_class:string,_VALUE:string>>, url_pdf string, problem string",
    )
    w = spark.createDataFrame([(1, 1, "UNO EJEMPLO SL", "Uno Ejemplo SL", None, None, None)], "company_id long, group_id long, name_key string, name string, incorporated date, address string, city string")
    sheets = spark.createDataFrame([], "province string, sheet string, company_id long")
    log = spark.createDataFrame([(D, "published", 1, [])], "day date, status string, n_documents long, errors array<string>")
    out = commands.ingest(spark, docs, w, sheets, log, docs.limit(0).select("doc_id"), "2020-01-01", "2020-01-05")
    assert [r.doc_id for r in out["notices"].collect()] == ["d2"]
    assert {r.day.day: r.status for r in out["days"].collect()} == {1: "published", 2: "published", 3: "failed"}
    again = commands.ingest(spark, docs, w, sheets, log, docs.select("doc_id"), "2020-01-01", "2020-01-05", again=True)
    assert sorted(r.doc_id for r in again["notices"].collect()) == ["d1", "d2"]


def announcement(num, firm, acts, sheet=None, day=D):
    return ("d", num, "A", "M", day, firm, [{"act_type": t, "heading": t, "detail": d} for t, d in acts], sheet, None)


SCHEMA = "doc_id string, num long, section string, province string, day date, firm string, acts array<struct<act_type:string,heading:string,detail:string>>, sheet string, inscription_date date"


def test_rebuild_follows_leads_and_names_persons(spark):
    a = spark.createDataFrame(
        [
            announcement(1, "NUEVA SL", [("dissolution", "Voluntaria")], "M 7"),
            announcement(2, "NUEVA SL", [("sole_shareholder_declared", "Socio único: UNO EJEMPLO SL")], "M 7"),
            announcement(3, "AJENA SL", [("appointment", "Adm. Unico: GARCIA LOPEZ ANA")]),
            announcement(4, "LEJOS SL", [("dissolution", "")], "M 8"),
            announcement(5, "NADA SL", [("dissolution", "")], "M 9"),
        ],
        SCHEMA,
    )
    w = spark.createDataFrame([(1, 4, "UNO EJEMPLO SL", "Uno Ejemplo SL", None, None, None)], "company_id long, group_id long, name_key string, name string, incorporated date, address string, city string")
    sheets = spark.createDataFrame([], "province string, sheet string, company_id long")
    pairs = spark.createDataFrame([("GARCIA LOPEZ", 4)], "pair string, group_id long")
    leads = spark.createDataFrame([(3, "M", "M 8", "open", "mention")], "lead_id long, province string, sheet string, state string, found_by string")
    out = commands.rebuild(a, w, sheets, pairs=pairs, leads=leads)
    got = {r.num: (r.kept_as, r.lead_id, r.signal) for r in out["notices"].collect()}
    assert got == {1: ("candidate", "NUEVA SL|M", None), 2: ("candidate", "NUEVA SL|M", "mention"), 3: ("candidate", None, "person"), 4: ("candidate", "3", None)}
    assert rows(out["leads"], "firm_key", "reason", "state") == [("AJENA SL", "person", "open"), ("NUEVA SL", "mention", "open")]


def test_guard_days_reach_the_match(spark):
    a = spark.createDataFrame([announcement(1, "UNO EJEMPLO SL", [("dissolution", "")])], SCHEMA)
    w = spark.createDataFrame([(1, 4, "UNO EJEMPLO SL", "Uno Ejemplo SL", date(2020, 3, 1), None, None)], "company_id long, group_id long, name_key string, name string, incorporated date, address string, city string")
    sheets = spark.createDataFrame([], "province string, sheet string, company_id long")
    assert [commands.rebuild(a, w, sheets, guard_days=n)["notices"].first().kept_as for n in (93, 30)] == ["watched", "review"]


def test_calibration_and_formats_in_one_scan(spark, sf_dir):
    g = queries.Gazette(spark, sf_dir, keep=True)
    a = g.full.withColumns({"section": F.lit("A"), "other_companies": F.array().cast("array<string>")})
    w = synth.watched(spark, sf_dir)
    related = w.select(F.col("name_key").alias("firm_key"))
    acts, holdings = g.acts, g.events()
    out = commands.calibrate(a, acts, holdings, w, synth.sheets(spark, sf_dir), queries._tokens(spark, sf_dir), related, cutoff=100.0)
    counts = {k: v.count() for k, v in out.items()}
    assert counts["addresses"] == w.select(F.col("company_id") % 40).distinct().count() and counts["fuzzy"] == 0
    assert out["acts"].agg(F.sum("n")).first()[0] == acts.count() and out["lag"].agg(F.sum("n")).first()[0] == a.filter("inscription_date is not null").count()
    assert rows(out["addresses"]) == rows(queries.q_address_use(spark, sf_dir))
    printed = commands.formats(a, acts, holdings, 2, 1)
    got = {k: v.count() for k, v in printed.items()}
    assert got["company_words"] == 0 and got["role_labels"] == 6 and got["boundaries"] == 1
    assert printed["holders"].first().holders == holdings.count() and printed["holders"].first().companies == 0
    assert {r.act_type: r.streets for r in printed["record"].collect()}["incorporation"] == acts.filter("act_type = 'incorporation'").count()
    assert printed["street_lengths"].agg(F.sum("n")).first()[0] == acts.filter("act_type in ('incorporation', 'address_change')").count()


def test_quirks_and_word_lists(spark):
    h = spark.createDataFrame([("UNO SL", "UNO SL", "Adm.", True), ("FUNDACION DOS", "FUNDACION DOS", "Adm.", True), ("ANA de la Torre", "ANA DE LA TORRE", "Adm.", False)], "holder string, holder_plain string, label string, is_company boolean")
    q = corpus.holder_quirks(h, ("COOPERATIVA",)).first()
    assert (q.holders, q.companies, q.companies_now_only, q.companies_before_only, q.with_digits) == (3, 2, 1, 0, 0)
    assert [r.w for r in h.select(corpus.was_company(F.col("holder"), ("FUNDACION",)).alias("w")).collect()] == [True, True, False]
    s = spark.createDataFrame([("CL MAYOR ALTA 3",), ("CL MAYOR BAJA 4",), ("CL OTRA 5",)], "street string")
    assert rows(corpus.generic_words(s, 2, 2), "word", "n") == [("MAYOR", 2)]
    labels = spark.createDataFrame([("Adm. Unico",), ("ADM. UNICO",), ("Raro",)], "label string")
    assert rows(corpus.role_labels(labels, 2)) == [("adm unico", "sole_director", 2)]
    assert [r.c for r in spark.createDataFrame([("UNO SL",), ("ANA PEREZ",)], "h string").select(corpus.carries_form(F.col("h")).alias("c")).collect()] == [True, False]
    many = spark.createDataFrame([("b", i) for i in range(5)] + [("c", 1)], "bucket string, i long")
    assert rows(corpus.samples(many, "bucket", ["i"], 2)) == [("b", 0), ("b", 1), ("c", 1)]


def test_windows_of_entries(spark):
    d = spark.createDataFrame([(False, date(2020, 1, 1), date(2020, 1, 11), 3), (True, D, D, 1), (False, None, D, None), (False, D, None, None)], "is_head boolean, founded date, sign_day date, handover int")
    assert rows(corpus.window_checks(d)) == [("founded_to_sign", "0-30", 1), ("sign_to_handover", "0-7", 1)]


def test_upkeep(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    n = spark.createDataFrame([("a", 1, None, None), ("a", None, 2, 7)], "doc_id string, company_id long, suggestion long, lead_id long")
    assert rows(process.stored_counts(docs, n)) == [("a", 2), ("b", 0)]
    counts = process.sweep_counts(n, docs, docs, docs.limit(1))
    assert counts == {"sheets": 2, "aliases": 2, "watched": 1, "of_leads": 1, "review": 1, "kept": 2, "leads": 1}
    stored = spark.createDataFrame([(1, 2020, "owner", True, False), (2, 2019, None, None, True), (3, None, None, None, False)], "company_id long, joined_year int, joined_evidence string, joined_confirmed boolean, joined_manual boolean")
    dated = spark.createDataFrame([(1, 2020, "owner", True), (2, 2021, "owner", True), (3, 2021, "owner", True)], "company_id long, year int, evidence string, confirmed boolean")
    assert rows(process.joined_changes(stored, dated)) == [(3, 2021, "owner", True)]
    events = spark.createDataFrame([("ANA", False, 1), ("ANA", False, 1), ("UNO SL", True, 1), ("EVA", False, 9)], "holder_plain string, is_company boolean, company_id long")
    members = spark.createDataFrame([(1, 4)], "company_id long, group_id long")
    assert rows(process.officer_names(events, members)) == [("ANA", 4)]
    w = spark.createDataFrame([(1, "Uno SL", "CL UNO 1", "MADRID")], "company_id long, name string, address string, city string")
    assert rows(process.watched_names(w, spark.createDataFrame([("Dos SL", 1)], "name string, company_id long"))) == [("Dos SL", 1), ("Uno SL", 1)]
    now = spark.createDataFrame([(1, "address", "CL DOS 2"), (1, "city", "LUGO")], "company_id long, field string, value string")
    assert rows(process.watched_addresses(w, now), "street") == [("CL DOS 2",), ("CL UNO 1",)]


def test_personal_holdings(spark):
    a = spark.createDataFrame([("d", 1, 1, "sole_shareholder_declared", "Socio único: GARCIA LOPEZ ANA"), ("d", 2, 1, "sole_shareholder_declared", "Socio único: UNO SL")], "doc_id string, num long, seq int, act_type string, detail string")
    assert rows(discovery.personal_holdings(a)) == [("d", 1)]
