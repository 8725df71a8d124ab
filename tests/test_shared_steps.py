"""Costly steps of the text rules stand once in their expressions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from actaflow.functions.places import amount_after
from actaflow.functions.text import name_key, split_form, strip_annotations, unaccent
from actaflow.operators.acts import inscription_date, registry_tail, segments, sheet_parts
from actaflow.operators.facts import observations


def written(spark, value) -> str:
    plan = spark.range(1).select(F.lit("x").alias("t"), F.lit("incorporation").alias("kind")).select(value.alias("v"))
    return plan._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize(
    "value, step, times",
    [
        (lambda: inscription_date(F.col("t")), "regexp_extract_all(", 1),
        (lambda: registry_tail(F.col("t")), "Datos", 2),
        (lambda: segments(F.col("t")), ", \x02, )", 1),
        (lambda: observations(F.col("kind"), F.col("t")), "Objeto", 1),
    ],
)
def test_steps_stand_once(spark, value, step, times):
    assert written(spark, value()).count(step) == times


def one(spark, value):
    return spark.range(1).select(value.alias("v")).first().v


def test_rules_read_as_before(spark):
    assert one(spark, unaccent(F.lit("Ñandú ﬁn é"))) == "Nandu ﬁn e"
    assert one(spark, unaccent(F.lit(None).cast("string"))) is None
    assert one(spark, strip_annotations(F.lit(" UNO SL (R.M. CIUDAD) (2019) "))) == "UNO SL"
    assert one(spark, strip_annotations(F.lit(" UNO SL "))) == "UNO SL"
    assert one(spark, name_key(F.lit("Uno, S. L. U."))) == "UNO SL"
    assert one(spark, split_form(F.lit("SL"))).asDict() == {"base": "SL", "form": None}
    assert one(spark, split_form(F.lit("UNO DOS SOCIEDAD LIMITADA"))).asDict() == {"base": "UNO DOS", "form": "SL"}
    assert one(spark, registry_tail(F.lit("A. Datos registrales. X. Datos  registrales: S 8 , H M 1."))).asDict() == {"body": "A. Datos registrales. X. ", "registry_data": "S 8 , H M 1"}
    assert one(spark, registry_tail(F.lit("nada"))).asDict() == {"body": "nada", "registry_data": None}
    assert one(spark, sheet_parts(F.lit("S 8 , H M 12 , 345, I/A"))).asDict() == {"letters": "M", "number": "12", "second": "345"}
    assert one(spark, sheet_parts(F.lit("sin hoja"))) is None
    assert str(one(spark, amount_after(F.lit("Capital: 1.234,5 Euros. Capital: 2 euros"), "Capital"))) == "1234.50"
    assert one(spark, amount_after(F.lit("Capital: mil"), "Capital")) is None
    cut = one(spark, segments(F.lit("Nota. - Constitución. Capital: 1 €. - Declaración de unipersonalidad. Socio único: ÑU SL. ")))
    assert cut.prefix == "Nota." and [(a.act_type, a.heading, a.detail) for a in cut.acts] == [("incorporation", "Constitución", "Capital: 1 €"), ("sole_shareholder_declared", "Declaración de unipersonalidad", "Socio único: ÑU SL")]


def test_exploded_steps_run_once(spark):
    """Of a bound array only the number is asked for; of an expression it would be made again."""
    from actaflow.operators.facts import slots

    acts = spark.createDataFrame([("D", 1, 1, "sole_shareholder_change", "Uno SL; Dos SA")], "doc_id string, num long, seq int, act_type string, detail string")
    plan = slots(acts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Listed with:") == 2  # the filter of acts, and the names
    assert [(r.at, r.kind, r.name) for r in slots(acts).orderBy("at").collect()] == [(0, "owned_by", "Uno SL"), (1, "owned_by", "Dos SA")]


def test_addresses_and_names_are_read_once(spark):
    """Equal results from addresses as printed and from sites of each announcement."""
    from actaflow.operators import discovery

    at = ["CL EJEMPLO 3 (MADRID)", "C/ Ejemplo, 3 (MADRID)", "CL OTRA 4 (TOLEDO)", "CL EJEMPLO 5", "(MADRID)"]
    acts = spark.createDataFrame([("D", i, 1, "address_change", at[i % 5]) for i in range(20)], "doc_id string, num long, seq int, act_type string, detail string")
    known = discovery.watched_sites(spark.createDataFrame([(2, 7, "CALLE EJEMPLO 3", "MADRID"), (1, 6, "CALLE EJEMPLO 3", "MADRID")], "pos long, group_id long, street string, city string"))
    addresses = discovery.registered_addresses(acts)
    assert addresses.columns == ["doc_id", "num", "seq", "street", "city"] and addresses.count() == 12
    hits = sorted(map(tuple, discovery.at_watched_sites(addresses, known).collect()))
    assert hits == sorted(map(tuple, discovery.at_watched_sites(discovery.registered_sites(acts), known).collect()))
    assert [(num, group) for _, num, _, group, _ in hits] == [(i, 6) for i in range(20) if i % 5 < 2]
    firms = spark.createDataFrame([("D", 1, "Uno Dos SL"), ("D", 2, "Uno Dos SL"), ("D", 3, "Tres SL"), ("D", 4, None)], "doc_id string, num long, firm string")
    tokens = spark.createDataFrame([("UNO", 1), ("UNO DOS", 2), ("TRES", 3)], "token string, group_id long")
    assert sorted(map(tuple, discovery.token_signal(firms, tokens).collect())) == [("D", 1, 2, 'token "UNO DOS"'), ("D", 2, 2, 'token "UNO DOS"'), ("D", 3, 3, 'token "TRES"')]


def test_ties_take_the_subject_from_their_acts(spark):
    from actaflow.operators.facts import relations

    acts = spark.createDataFrame([("D", 1, 1, "sole_shareholder_change", "Uno SL", "DOS SL"), ("D", 1, 2, "sole_shareholder_change", "Dos SL", "DOS SL")], "doc_id string, num long, seq int, act_type string, detail string, firm_key string")
    rows = relations(acts)
    assert sorted(rows.columns) == sorted(relations(acts, acts.select("doc_id", "num", "firm_key").distinct()).columns)
    assert [(r.firm_key, r.kind, r.other_key, r.other) for r in rows.collect()] == [("DOS SL", "owned_by", "UNO SL", "Uno SL")]


def test_edges_read_the_relations_once(spark, tmp_path):
    from actaflow.operators.graph import directed_edges

    rows = [("A", "owned_by", "B"), ("A", "absorbs", "C"), ("A", "transfers_to", "D"), ("A", "owned_by", "A"), ("A", "other", "E"), (None, "owned_by", "B")]
    spark.createDataFrame(rows, "firm_key string, kind string, other_key string").write.parquet(f"{tmp_path}/r")
    edges = directed_edges(spark.read.parquet(f"{tmp_path}/r"))
    assert sorted(map(tuple, edges.collect())) == [("A", "C"), ("A", "D"), ("B", "A"), ("C", "A")]
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
