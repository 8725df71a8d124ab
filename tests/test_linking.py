"""Links kept up to date: equal to a rebuild after every change of a random series."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from actaflow.operators import linking
from actaflow.operators.matching import learn

SCHEMA = "doc_id string, num long, province string, sheet string, firm_key string, fact_day date, ends_sheet boolean, new_keys array<string>"


def base(spark):
    watched = spark.createDataFrame([(1, "ALFA SL", None), (2, "BETA SL", datetime.date(2024, 6, 1)), (3, "GAMMA SA", None)], "company_id long, name_key string, incorporated date")
    sheets = spark.createDataFrame([("P", "M 1", 1)], "province string, sheet string, company_id long")
    aliases = spark.createDataFrame([("ALFA VIEJA SL", 1)], "name_key string, company_id long")
    return linking.Base(watched, sheets, aliases)


def document(rng, doc):
    names = ["ALFA SL", "BETA SL", "GAMMA SA", "ALFA VIEJA SL", *(f"N{i} SL" for i in range(9))]
    rows = []
    for num in range(rng.randint(1, 6)):
        day = datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randint(0, 300))
        new = [rng.choice(names)] if rng.random() < 0.35 else []
        rows.append((f"D{doc}", num, "P", rng.choice([None, *(f"M {i}" for i in range(10))]), rng.choice(names), day, rng.random() < 0.1, new))
    return rows


def contents(state):
    return (
        sorted(tuple(r) for r in state.sheets.select("province", "sheet", "company_id", "pass", "doc_id", "num").collect()),
        sorted(tuple(r) for r in state.aliases.select("name_key", "company_id", "pass", "doc_id", "num").collect()),
        sorted((tuple(r) for r in state.links.collect()), key=str),
    )


def test_equal_to_a_rebuild_after_every_change(spark):
    rng, known = random.Random(11), base(spark)
    at_hand = {d: document(rng, d) for d in range(10)}
    table = lambda rows: spark.createDataFrame(rows, SCHEMA)
    state = linking.link_all(table([r for d in at_hand.values() for r in d]), known)
    several = 0
    for _ in range(2):
        withdrawn = rng.sample(sorted(at_hand), 3)
        new = {d: document(rng, d) for d in rng.sample(range(14), 5)}
        for d in withdrawn:
            at_hand.pop(d)
        at_hand |= new
        gone = spark.createDataFrame([(f"D{d}",) for d in withdrawn], "doc_id string")
        state = linking.compacted(linking.apply_changes(state, known, table([r for d in new.values() for r in d]), gone))
        rebuilt = linking.link_all(table([r for d in at_hand.values() for r in d]), known)
        assert contents(state) == contents(rebuilt)
        several += len(contents(state)[1])
    assert several > 2  # aliases were learned on the way


def test_a_rebuild_learns_what_learn_does(spark):
    rng, known = random.Random(5), base(spark)
    rows = [r for d in range(25) for r in document(rng, d)]
    facts = spark.createDataFrame(rows, SCHEMA)
    state = linking.link_all(facts, known)
    renames = facts.select("doc_id", "num", F.explode("new_keys").alias("new_key"))
    sheets, aliases = learn(facts.drop("new_keys"), known.watched, known.sheets, known.aliases, renames)
    own = {tuple(r) for r in state.sheets.select("province", "sheet", "company_id").collect()} | {("P", "M 1", 1)}
    assert own == {tuple(r) for r in sheets.collect()}
    assert {tuple(r) for r in state.aliases.select("name_key", "company_id").collect()} | {("ALFA VIEJA SL", 1)} == {tuple(r) for r in aliases.collect()}


def test_a_withdrawn_teacher_takes_what_followed_from_it(spark):
    known, day = base(spark), datetime.date(2024, 7, 1)
    rows = [
        ("D1", 0, "P", None, "ALFA SL", day, False, ["N1 SL"]),  # N1 is ALFA from here on
        ("D2", 0, "P", "M 7", "N1 SL", day, False, []),  # so M 7 is ALFA's
        ("D3", 0, "P", "M 7", "N2 SL", day, False, ["N3 SL"]),  # and so are N2 and N3
        ("D4", 0, "P", "M 9", "N3 SL", day, False, []),
        ("D5", 0, "P", "M 8", "GAMMA SA", day, False, []),
    ]
    facts = spark.createDataFrame(rows, SCHEMA)
    state = linking.link_all(facts, known)
    assert [r["pass"] for r in state.sheets.orderBy("sheet").collect()] == [2, 1, 4]
    left = linking.apply_changes(state, known, facts.limit(0), spark.createDataFrame([("D1",)], "doc_id string"))
    assert [(r.sheet, r.company_id) for r in left.sheets.collect()] == [("M 8", 3)] and left.aliases.count() == 0
    assert [(r.doc_id, r.company_id) for r in left.links.collect()] == [("D5", 3)]
    back = linking.apply_changes(left, known, facts.filter("doc_id = 'D1'"))
    assert contents(back) == contents(state)
    same = linking.apply_changes(state, known, facts.filter("doc_id = 'D1'"))
    assert contents(same) == contents(state)


def test_years_swept_in_any_order_end_alike(spark):
    rng, known = random.Random(8), base(spark)
    facts = spark.createDataFrame([r for d in range(12) for r in document(rng, d)], SCHEMA)
    # a document has one day here, as the gazette's do
    facts = facts.withColumn("fact_day", F.make_date(F.lit(2022) + F.substring("doc_id", 2, 9).cast("int") % 2, F.lit(7), F.lit(1)))
    years = [(datetime.date(y, 1, 1), datetime.date(y, 12, 31)) for y in (2022, 2023)]
    none = linking.link_all(facts.limit(0), known)
    forth, report = linking.sweep(none, known, facts, years)
    back, other = linking.sweep(none, known, facts, years[::-1])
    whole = contents(linking.link_all(facts, known))
    assert contents(forth) == whole == contents(back)
    totals = lambda r: r.groupBy().sum("sheets", "aliases", "links").first()
    assert totals(report) == totals(other) and totals(report)[2] > 0
    again, nothing = linking.sweep(forth, known, facts, years[:1])
    assert [tuple(r)[3:] for r in nothing.collect()] == [(0, 0, 0)] and contents(again) == whole
