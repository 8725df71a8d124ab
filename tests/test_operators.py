"""Joins, records, positions, graphs and measures against brute force and replays."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from actaflow.functions import catalogue as C
from actaflow.operators import discovery, graph, matching, measure, positions, record, timeline

D0 = date(2020, 1, 1)


def test_positions_equal_a_replay(spark):
    """The windows against a replay of each company's events in order."""
    rng = random.Random(6)
    roles = {"sole_director": "sole", "joint_director": "joint", "board_member": "board", "auditor": None, "attorney": None, "secretary": "board"}
    rows, n = [], 0
    for company in range(150):
        for _ in range(rng.randrange(1, 14)):
            n += 1
            role = rng.choice(list(roles))
            rows.append((company, D0 + timedelta(days=rng.randrange(6)), n, rng.choice(["ANA RUIZ", "RUIZ ANA", "PEPE GIL", "LUZ MAR"]), role, rng.choice(["Auditor", "Aud.Supl."]) if role == "auditor" else "x", rng.choice(["appointment", "reelection", "removal", "revocation"])))
    got = {r.event_id for r in positions.positions_held(spark.createDataFrame(rows, "company_id long, day date, event_id long, holder string, role string, label string, kind string")).collect()}
    expected = set()
    for company in range(150):
        mine = sorted((r for r in rows if r[0] == company), key=lambda r: (r[1], r[2]))
        last, seats, bodies = {}, {}, {}
        for r in mine:
            last[" ".join(sorted(r[3].split())), r[4]] = r
            if r[6] in C.OPENING_EVENTS:
                seat = {"auditor": "aud" + ("s" if "Su" in r[5] else ""), "sole_director": "sole"}.get(r[4])
                if seat:
                    seats[seat] = r[1]
                if roles[r[4]]:
                    bodies.setdefault(r[1], set()).add(roles[r[4]])
        for r in last.values():
            seat = {"auditor": "aud" + ("s" if "Su" in r[5] else ""), "sole_director": "sole"}.get(r[4])
            left = max((d for d, f in bodies.items() if roles[r[4]] and roles[r[4]] not in f), default=None)
            if r[6] in C.OPENING_EVENTS and not (seat and seats[seat] > r[1]) and not (left and left > r[1]):
                expected.add(r[2])
    assert got == expected


def watched_table(spark):
    return spark.createDataFrame([(1, 1, "UNO SL", date(2020, 6, 1)), (2, 1, "DOS SA", None), (3, 2, "TRES NORTE SL", None)], "company_id long, group_id long, name_key string, incorporated date")


def test_matching(spark):
    sheets = spark.createDataFrame([("M", "1", 2)], "province string, sheet string, company_id long")
    aliases = spark.createDataFrame([("VIEJO SL", 3), ("UNO SL", 3)], "name_key string, company_id long")
    rows = [
        (1, "M", "1", "OTRA SL", D0, 2, "sheet", None), (2, "M", None, "UNO SL", date(2020, 5, 1), 1, "name", None), (3, "M", None, "UNO SL", date(2020, 1, 1), None, "none", 1),
        (4, "M", None, "VIEJO SL", D0, 3, "name", None), (5, "M", None, "", D0, None, "none", None), (6, "M", None, "TRES NORTES SL", D0, None, "none", 3), (7, "M", None, "DOS SL", D0, None, "none", 2), (8, "M", None, "NADA SL", D0, None, "none", None),
    ]
    a = spark.createDataFrame([(r[0], *r[1:5]) for r in rows], "num long, province string, sheet string, firm_key string, fact_day date")
    got = {r.num: (r.company_id, r.via, r.suggestion) for r in matching.match(a, watched_table(spark), sheets, aliases).collect()}
    assert got == {r[0]: r[5:] for r in rows}


def test_learning_does_not_depend_on_order(spark):
    """A name of year one is only known after a rename of year two."""
    w = watched_table(spark)
    rows = [("d1", 1, "M", "9", "ANTES SL", date(2018, 1, 1), False), ("d2", 1, "M", "9", "DOS SA", date(2019, 1, 1), False), ("d3", 1, "M", "8", "ANTES SL", date(2020, 1, 1), True), ("d4", 1, "M", "7", "ANTES SL", date(2021, 1, 1), False)]
    renames = spark.createDataFrame([("d2", 1, "ANTES SL")], "doc_id string, num long, new_key string")
    for order in (rows, rows[::-1]):
        a = spark.createDataFrame(order, "doc_id string, num long, province string, sheet string, firm_key string, fact_day date, ends_sheet boolean")
        known, names = matching.learn(a, w, spark.createDataFrame([], "province string, sheet string, company_id long"), spark.createDataFrame([], "name_key string, company_id long"), renames)
        assert sorted((r.sheet, r.company_id) for r in known.collect()) == [("7", 2), ("9", 2)]
        assert [(r.name_key, r.company_id) for r in names.collect()] == [("ANTES SL", 2)]


def test_learning_follows_long_chains_of_renames(spark):
    """Each name is only known through the one before, one pass later."""
    w = watched_table(spark)
    rows = [(f"d{i}", 1, "M", f"s{i}", "DOS SA" if i == 0 else f"NAME {i} SL", date(2018, 1, 1) + timedelta(days=i), False) for i in range(5)]
    renames = spark.createDataFrame([(f"d{i}", 1, f"NAME {i + 1} SL") for i in range(5)], "doc_id string, num long, new_key string")
    a = spark.createDataFrame(rows, "doc_id string, num long, province string, sheet string, firm_key string, fact_day date, ends_sheet boolean")
    known, names = matching.learn(a, w, spark.createDataFrame([], "province string, sheet string, company_id long"), spark.createDataFrame([], "name_key string, company_id long"), renames)
    assert known.count() == 5 and names.count() == 5 and {r.company_id for r in names.collect()} == {2}


@pytest.mark.parametrize("cutoff", [90, 70])
def test_fuzzy_candidates_lose_nothing(spark, cutoff):
    rng = random.Random(9)
    letters = "ABCDEFG "
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 24))).strip() or "A" for _ in range(60)]
    typos = []
    for b in base:
        for _ in range(2):
            x = list(b)
            for _ in range(rng.randrange(0, 3)):
                k = rng.randrange(len(x) + 1)
                x[k : k + rng.randrange(0, 2)] = rng.choice(letters) if rng.random() < 0.5 else ""
            typos.append("".join(x).strip())
    def lcs(a, b):
        t = [0] * (len(b) + 1)
        for x in a:
            diagonal = 0
            for j, y in enumerate(b, 1):
                diagonal, t[j] = t[j], diagonal + 1 if x == y else max(t[j], t[j - 1])
        return t[-1]

    names = [t for t in set(typos) if t]
    expected = {}
    for t in names:
        best = max(((200 * lcs(t, b) / (len(t) + len(b)), -i, b) for i, b in enumerate(base)), default=None)
        if best[0] >= cutoff:
            expected[t] = (best[2], round(best[0], 6))
    got = matching.similar_names(spark.createDataFrame([(n,) for n in names], "base string"), spark.createDataFrame([(b, i) for i, b in enumerate(base)], "base string, pos long"), cutoff)
    assert {r.base: (r.close, round(r.score, 6)) for r in got.collect()} == expected


def values_table(spark, rows):
    return spark.createDataFrame(rows, "company_id long, source string, doc_id string, num long, day date, field string, value string")


def test_record(spark):
    day = lambda n: D0 + timedelta(days=n)
    values = values_table(spark, [
        (1, "watchlist", None, None, day(9), "name", "W"), (1, "registry", "a", 1, day(1), "name", "R1"), (1, "registry", "b", 1, day(2), "name", "R2"),
        (1, "registry", "a", 1, day(1), "status", "dissolved"), (1, "registry", "a", 2, day(1), "status", "extinct"), (2, "registry", "a", 3, day(1), "status", "dissolved"), (2, "registry", "a", 3, day(1), "status", "active"),
        (3, "registry", "z", 1, day(5), "status", "extinct")])
    notices = spark.createDataFrame([(1, day(3)), (2, day(3)), (3, day(5)), (None, day(9))], "company_id long, fact_day date")
    now = record.record_now(values, notices)
    assert {(r.company_id, r.field): r.value for r in now.collect()} == {(1, "name"): "R2", (2, "status"): "dissolved", (3, "status"): "extinct"}
    watched = spark.createDataFrame([(1, "W", "x", "y", "1", None, "active"), (2, "B", None, None, None, None, "dissolved"), (3, "C", None, None, None, "p", "extinct")], "company_id long, name string, address string, city string, capital string, purpose string, status string")
    log = spark.createDataFrame([(1, 3, "purpose", "old", "p", "applied", day(0), "d", 1), (2, 2, "city", "q", "z", "applied", day(0), "d", 1)], "entry_id long, company_id long, field string, replaced string, written string, state string, fact_day date, doc_id string, num long")
    found = record.proposals(watched, now, log)
    assert sorted((r.why, r.company_id, r.field, r.held, r.proposed) for r in found.collect()) == [("registry", 1, "name", "W", "R2"), ("unbacked", 3, "purpose", "p", "old")]
    after = {r.company_id: r for r in record.apply_proposals(watched, found).collect()}
    assert after[1].name == "R2" and after[3].purpose == "old" and after[2].name == "B"
    logged = record.apply_log(log, found, None).collect()
    assert sorted((r.company_id, r.field, r.state) for r in logged) == [(1, "name", "applied"), (2, "city", "applied"), (3, "purpose", "reverted")]


def test_closure(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "c"), ("d", "e")], "src string, dst string")
    seeds = spark.createDataFrame([("a", 1), ("x", 2)], "node string, group_id long")
    got = {r.node: (r.group_id, r.depth) for r in graph.closure(edges, seeds).collect()}
    assert got == {"b": (1, 1), "c": (2, 1), "d": (2, 2), "e": (2, 3)}
    assert {r.node for r in graph.closure(edges, seeds, 1).collect()} == {"b", "c"}
    ties = spark.createDataFrame([("s", "owned_by", "o"), ("s", "transfers_to", "t"), ("s", "absorbs", "m")], "firm_key string, kind string, other_key string")
    assert {(r.src, r.dst) for r in graph.directed_edges(ties).collect()} == {("o", "s"), ("s", "t"), ("m", "s"), ("s", "m")}


def test_leads_notices_and_prune(spark):
    old = spark.createDataFrame([("K", "M", 1, "token", "e", "K SL", D0, D0, "gone")], "firm_key string, province string, group_id long, reason string, evidence string, firm string, first_day date, last_day date, state string")
    found = spark.createDataFrame([("K", "M", 2, "mention", "f", "K2", date(2021, 1, 1), "d", 1), ("N", "M", 2, "address", "g", "N SL", D0, "d", 2)], "firm_key string, province string, group_id long, reason string, evidence string, firm string, fact_day date, doc_id string, num long")
    got = {r.firm_key: (r.group_id, r.reason, r.state, r.last_day) for r in discovery.upsert_leads(old, found).collect()}
    assert got == {"K": (1, "token", "open", date(2021, 1, 1)), "N": (2, "address", "open", D0)}


def test_pairs_and_best_pair(spark):
    texts = spark.createDataFrame([("d", 1, "RUIZ VALLE ANA"), ("d", 2, "VALLE SOLO")], "doc_id string, num long, text string")
    pairs = spark.createDataFrame([("ANA VALLE", 1), ("SOLO RUIZ", 2)], "pair string, group_id long")
    assert [(r.num, r.pair) for r in discovery.pairs_in(texts, pairs).collect()] == [(1, "ANA VALLE")]
    none = spark.createDataFrame([], "doc_id string, num long")
    assert [(r.num, r.group_id) for r in discovery.person_signal(texts, pairs, none).collect()] == [(1, 1)]
    words = spark.createDataFrame([("ANA", 100), ("VALLE", 2), ("RUIZ", 50)], "word string, n long")
    counts = spark.createDataFrame([("RUIZ VALLE", 4)], "pair string, n long")
    got = discovery.best_pair(texts.select(F.col("text").alias("name")).limit(1), words, counts).first()
    assert (got.pair, got.n) == ("RUIZ VALLE", 4)


def test_timeline(spark):
    day = lambda n: D0 + timedelta(days=n)
    members = spark.createDataFrame([(i, i == 0, date(2019, 1, 1) if i in (0, 5) else None) for i in range(7)], "company_id long, is_head boolean, incorporated date")
    facts = [
        (1, day(0), 1, "incorporated", False, "i"), (1, day(90), 2, "owner", True, "G SL"),
        (2, day(0), 1, "incorporated", False, "i"), (2, day(900), 2, "body_in", True, "Adm"),
        (3, day(10), 1, "body_in", True, "Adm"), (3, day(25), 2, "body_out", False, "Adm"),
        (4, day(10), 1, "body_in", False, "Adm"), (5, day(10), 1, "owner", True, "G"), (6, day(10), 1, "owner", True, "G"),
    ]
    f = spark.createDataFrame(facts, "company_id long, day date, at long, kind string, by_group boolean, note string")
    got = {r.company_id: (r.rule, r.entry_day, r.evidence, r.confirmed, r.year) for r in timeline.date_entries(members, f, F.to_date(F.lit("2009-01-02"))).collect()}
    assert got == {
        0: ("head", date(2019, 1, 1), "incorporation", False, 2019), 1: ("founded", day(0), "owner", True, 2020), 2: ("acquired", day(900), "officers", False, 2022),
        3: ("acquired", day(10), "officers", False, 2020), 4: ("untied", None, None, False, None), 5: ("listed", date(2019, 1, 1), "incorporation", False, 2019), 6: ("already_in", None, None, False, None),
    }


def test_ties_and_group_officers(spark):
    slots = spark.createDataFrame([(1, 1, D0, 2, "owned_by")], "company_id long, group_id long, day date, at long, kind string")
    bodies = spark.createDataFrame([(1, 1, D0, 1, "chair", True), (2, 1, D0, 1, "sole_director", True), (3, 1, D0, 1, "sole_director", False)], "company_id long, group_id long, day date, at long, role string, opens boolean")
    assert {r.company_id: r.tie for r in timeline.tie_to_group(slots, bodies).collect()} == {1: "owned_by", 2: "run_by", 3: "on_body"}
    members = spark.createDataFrame([(i, 1, i == 0) for i in range(5)], "company_id long, group_id long, is_head boolean")
    rows = [(0, "HEAD P", "chair", False, "removal")] + [(i, "MANY P", "chair", False, "appointment") for i in (1, 2, 3)] + [(i, "FEW P", "chair", False, "appointment") for i in (1, 2)] + [(0, "CO SL", "chair", True, "appointment"), (0, "SEC P", "secretary", False, "appointment")]
    h = spark.createDataFrame(rows, "company_id long, holder_plain string, role string, is_company boolean, kind string")
    assert {r.holder_plain for r in timeline.group_officers(h, members).collect()} == {"HEAD P", "MANY P"}


def test_measures(spark):
    tally = spark.createDataFrame([(1, 10), (2, 80), (9, 10)], "days int, n long")
    assert [measure.discrete_quantile(tally, "days", "n", q).first().value for q in (0.1, 0.11, 0.9, 0.95)] == [1, 2, 2, 9]
    days = spark.createDataFrame([(-1,), (0,), (30,), (31,), (5000,)], "d int")
    assert [r[0] for r in days.select(measure.band(F.col("d"), (0, 31, 91))).collect()] == ["before", "0-30", "0-30", "31-90", "91+"]
    flagged = spark.createDataFrame([("token", "A", 1), ("token", "B", 2), ("token", "C", 1)], "reason string, firm_key string, group_id long")
    truth = spark.createDataFrame([("A", 1), ("B", 1), ("D", 1), ("Z", 1)], "firm_key string, group_id long")
    subjects = spark.createDataFrame([("A",), ("B",), ("D",)], "firm_key string")
    r = measure.evaluate(flagged, truth, subjects).first()
    assert (r.flagged, r.true_positive, r.wrong_group) == (3, 1, 1) and r.precision == pytest.approx(1 / 3) and r.recall == pytest.approx(1 / 3)
    merged = measure.union_truths(truth, spark.createDataFrame([("A", 9), ("Q", 9)], "firm_key string, group_id long"))
    assert {x.firm_key: x.group_id for x in merged.collect()} == {"A": 1, "B": 1, "D": 1, "Z": 1, "Q": 9}
    lengths = spark.createDataFrame([(47, 30), (48, 28), (49, 40), (50, 60), (51, 2)], "length int, n long")
    assert measure.cut_length(lengths) == 49 and measure.cut_length(lengths.limit(0)) is None
    assert measure.cut_length(spark.createDataFrame([(1, 9), (2, 5)], "length int, n long")) is None


def test_triage_tiers(spark):
    rows = [(i, 1, f"F{i} SL", "mention", 2**i, D0, "open") for i in range(10)] + [(99, 1, "G SL", "mention", 5, D0, "gone")]
    leads = spark.createDataFrame(rows, "lead_id long, group_id long, firm string, reason string, n long, last_day date, state string")
    tokens = spark.createDataFrame([("F3", 1)], "token string, group_id long")
    got = measure.triage(leads, tokens, F.to_date(F.lit("2020-01-01")), {"mention": 0.5, "token": 0.5}).collect()
    tiers = [r.tier for r in sorted(got, key=lambda r: r.place)]
    assert tiers == ["first"] * 2 + ["next"] * 3 + ["rest"] * 5
    assert next(r for r in got if r.lead_id == 3).brand and len(got) == 10


def test_process_steps(spark):
    from actaflow.operators import process

    leads = spark.createDataFrame([(7, "M", "1", "open", "mention"), (5, "M", "1", "open", "mention"), (3, "M", "2", "gone", "mention"), (2, "M", "3", "open", "token")], "lead_id long, province string, sheet string, state string, found_by string")
    followed = process.followed_sheets(leads)
    assert [(r.sheet, r.lead_id) for r in followed.collect()] == [("1", 5)]
    rows = [(1, "9", 4, None), (2, "9", None, 3), (3, "1", None, None), (4, "9", None, None), (5, "9", None, None)]
    a = spark.createDataFrame([("d", n, "M", s, c, g) for n, s, c, g in rows], "doc_id string, num long, province string, sheet string, company_id long, suggestion long")
    found = spark.createDataFrame([("d", 4, 1, "token", "e")], "doc_id string, num long, group_id long, reason string, evidence string")
    kept = {r.num: r.kept_as for r in process.cascade(a, followed, found).collect()}
    assert kept == {1: "watched", 2: "review", 3: "candidate", 4: "candidate", 5: "discard"}
    later = {r.num: r.kept_as for r in process.cascade(a, followed, found, known_only=True).collect()}
    assert later == {1: "watched", 2: "discard", 3: "candidate", 4: "discard", 5: "discard"}
    assert {r.num: r.kept_as for r in process.cascade(a, followed, found, store_all=True).collect()}[5] == "all"
    old = spark.createDataFrame([(1, None, "x")], "k long, v string, w string")
    new = spark.createDataFrame([(1, None, "y"), (2, "a", "second"), (2, "a", "first")], "k long, v string, w string")
    assert sorted((r.k, r.w) for r in process.insert_absent(old, new, ["k", "v"], ["w"]).collect()) == [(1, "x"), (2, "first")]
    assert process.added_anything({"sheets": 1, "aliases": 0, "watched": 2, "of_leads": 0}, {"sheets": 1, "aliases": 0, "watched": 3, "of_leads": 0})


def test_leads_are_judged_again(spark):
    from actaflow.operators import process

    leads = spark.createDataFrame([(i, f"K{i}", "M", str(i), 1, "token", "old", "open", 3, D0, D0) for i in (1, 2, 3, 4)], "lead_id long, firm_key string, province string, sheet string, group_id long, found_by string, evidence string, state string, notice_count long, first_day date, last_day date")
    keys, sheets = spark.createDataFrame([("K1",)], "name_key string"), spark.createDataFrame([("M", "2")], "province string, sheet string")
    found = spark.createDataFrame([(1, 9, "mention", "new"), (3, 2, "mention", "new")], "lead_id long, group_id long, reason string, evidence string")
    got = {r.lead_id: (r.state, r.group_id, r.found_by, r.evidence) for r in process.rejudge(leads, keys, sheets, found).collect()}
    assert got == {1: ("watched", 1, "token", "old"), 2: ("watched", 1, "token", "old"), 3: ("open", 2, "mention", "new"), 4: ("gone", 1, "token", "old")}
    notices = spark.createDataFrame([(1, date(2021, 1, 1)), (1, date(2019, 1, 1)), (None, D0)], "lead_id long, fact_day date")
    counts = {r.lead_id: (r.notice_count, r.first_day.year, r.last_day.year) for r in process.refresh_leads(leads, notices).collect()}
    assert counts == {1: (2, 2019, 2021), 2: (3, 2020, 2020), 3: (3, 2020, 2020), 4: (3, 2020, 2020)}


def test_corpus_counts(spark):
    from actaflow.operators import corpus

    rows = [("M", "1", 1, "A", []), ("M", "1", 2, "B", ["name_change"]), ("M", "1", 3, "C", ["extinction"]), ("M", "1", 4, "A", []), ("M", None, 5, "A", []), ("M", "2", 6, "Z", ["dissolution"]), ("M", "2", 7, "Z", ["dissolution"])]
    r = corpus.sheet_stability(spark.createDataFrame(rows, "province string, sheet string, ord long, firm_key string, types array<string>")).first()
    assert (r.with_sheet, r.after_rename, r.after_rename_other_name, r.after_extinction, r.after_dissolution, r.name_differs_without_rename, r.renamed_sheets, r.extinct_sheets, r.dissolved_sheets, r.distinct_sheets) == (6, 2, 1, 1, 1, 1, 1, 1, 1, 2)
    s = spark.createDataFrame([("A", "M", ("GR", "10", None)), ("A", "M", ("GR", "10", "20001")), ("B", "M", ("GR", "1", "0001")), ("C", "M", ("GR", "1", "22")), ("C", "M", ("GR", "22", None))], "firm_key string, province string, parts struct<letters:string,number:string,second:string>")
    assert {(x.kind, x.verdict): x.n for x in corpus.sheet_verdicts(s).collect()} == {("5 digits", "first"): 1, ("repeats the first", "no other announcement"): 1, ("2 digits", "second"): 1}
    b = corpus.boundaries(spark.createDataFrame([("Nombramientos. Adm: PERSONA UNODisolución. Voluntaria. - Extinción. X",), ("nada",)], "body string")).first()
    assert (b.announcements, b.glued_to_capital, b.after_dot_space_dash, b.announcements_affected) == (2, 1, 1, 1)
    dated = spark.createDataFrame([("founded", D0, True, date(2020, 5, 1), "officers"), ("acquired", D0, True, None, None), ("acquired", D0, False, D0, "officers")], "rule string, entry_day date, confirmed boolean, officers_day date, officers_evidence string")
    assert {(x.rule, x.verdict): x.days for x in corpus.officers_against_owner(dated).collect()} == {("founded", "officers, same year"): [121], ("acquired", "officers give no year"): []}
    lengths = spark.createDataFrame([(1, 90), (5, 9), (9, 1)], "length int, n long")
    assert [corpus.length_quantile(lengths, q) for q in (0.5, 0.95, 1.0)] == [1, 5, 9]
    firms = spark.createDataFrame([("TALLERES NORTES SL", 1), ("TALLERES NORTE SA", 2)], "firm_key string, sheet_owner long")
    w = spark.createDataFrame([("TALLERES NORTE SL", 1)], "name_key string, company_id long")
    assert [(x.band, x.truth, x.names) for x in corpus.fuzzy_bands(firms, w).collect()] == [(95, "same", 1)]
    st = spark.createDataFrame([("CL MAYOR 3 PISO 2",)] * 3, "street string")
    assert {x.word for x in corpus.street_words(st, spark.createDataFrame([("MADRID",)], "city string"), 3, 0.5, 1).collect()} == {"PISO"}
