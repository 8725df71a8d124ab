"""Positions held: the officer events that nothing has ended since."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actaflow.functions import catalogue as C
from actaflow.functions.text import auditor_class, person_key

FORMS = tuple(sorted(set(C.BODY_FORM.values())))


def body_form(role: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, form in C.BODY_FORM.items():
        out = F.when(role == name, F.lit(form)).otherwise(out)
    return out


def seat(role: Column, label: Column) -> Column:
    """The seat that one appointment at a time fills; null for roles without one."""
    return F.when(role == "auditor", F.concat(F.lit("auditor: "), auditor_class(label))).when(role == "sole_director", "sole director")


def positions_held(events: DataFrame) -> DataFrame:
    """The events (company_id, day, event_id, holder, role, label, kind) that opened a
    position held today.

    The last event of a person in a role must open it; no later day may fill its seat
    again, nor appoint the body without its form.  Appointments and re-elections open."""
    e = events.withColumns({"_person": person_key(F.col("holder")), "_opens": F.col("kind").isin(*C.OPENING_EVENTS), "_seat": seat(F.col("role"), F.col("label")), "_form": body_form(F.col("role"))})
    last = Window.partitionBy("company_id", "_person", "role").orderBy(F.desc("day"), F.desc("event_id"))
    final = e.withColumn("_n", F.row_number().over(last)).filter("_n = 1 and _opens").drop("_n")
    opened = e.filter("_opens")
    seats = opened.filter("_seat is not null").groupBy("company_id", "_seat").agg(F.max("day").alias("_seat_day"))
    bodies = opened.filter("_form is not null").groupBy("company_id", "day").agg(F.collect_set("_form").alias("_forms"))
    left_out = bodies.select("company_id", "day", F.explode(F.array_except(F.array(*map(F.lit, FORMS)), F.col("_forms"))).alias("_form")).groupBy("company_id", "_form").agg(F.max("day").alias("_left_day"))
    out = final.join(seats, ["company_id", "_seat"], "left").join(left_out, ["company_id", "_form"], "left")
    out = out.filter(F.coalesce(F.col("_seat_day") <= F.col("day"), F.lit(True)) & F.coalesce(F.col("_left_day") <= F.col("day"), F.lit(True)))
    return out.select(*events.columns)


def naive_positions(events: DataFrame) -> DataFrame:
    """The last event of each (company, holder as printed, role), if it opens."""
    from actaflow.functions.text import plain

    w = Window.partitionBy("company_id", plain(F.col("holder")), "role").orderBy(F.desc("day"), F.desc("event_id"))
    return events.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).filter(F.col("kind").isin(*C.OPENING_EVENTS)).drop("_n")


def reordered_names(events: DataFrame) -> DataFrame:
    """(names, persons, merged): names as printed, persons with two or more, their names."""
    from actaflow.functions.text import plain

    first = events.groupBy("company_id", "role", plain(F.col("holder")).alias("_plain")).agg(F.min_by("holder", "event_id").alias("holder"))
    persons = first.groupBy("company_id", "role", person_key(F.col("holder")).alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    return persons.agg(F.sum("n").alias("names"), F.count_if(F.col("n") > 1).alias("persons"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("merged"))


def powers_spread(events: DataFrame, members: DataFrame) -> DataFrame:
    """The same person, day and kind in two or more companies of a group."""
    from actaflow.functions.text import plain

    e = events.join(members.select("company_id", "group_id"), "company_id")
    pairs = e.groupBy("group_id", plain(F.col("holder")).alias("holder_plain"), "day", "kind", "company_id").agg(F.count(F.lit(1)).alias("_n"))
    return pairs.groupBy("group_id", "holder_plain", "day", "kind").agg(F.count(F.lit(1)).alias("companies")).filter("companies >= 2")
