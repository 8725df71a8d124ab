"""When a company joined its group: dated facts, then the first rule that applies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actaflow.functions import catalogue as C


def group_officers(holdings: DataFrame, members: DataFrame, least: int = C.GROUP_OFFICER_MIN) -> DataFrame:
    """(group_id, holder_plain): natural persons in a control role of the group's head, or
    brought into the bodies of ``least`` or more of its watched companies."""
    h = holdings.filter(F.col("role").isin(*C.CONTROL_ROLES) & ~F.col("is_company")).join(members.select("company_id", "group_id", "is_head"), "company_id")
    heads = h.filter("is_head").select("group_id", "holder_plain")
    into = h.filter(F.col("kind").isin(*C.OPENING_EVENTS)).select("group_id", "holder_plain", "company_id").distinct()
    many = into.groupBy("group_id", "holder_plain").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("group_id", "holder_plain")
    return heads.union(many).distinct()


def entry_facts(facts: DataFrame) -> DataFrame:
    """What the rules need of (company_id, day, at, kind, by_group, note): one row a company.

    ``kind`` is incorporated, owner, body_in or body_out; ``at`` orders the facts of a day.
    One aggregation finds the first facts, a join on the group's first sign the rest."""
    order = F.struct("day", "at")
    fact = F.struct("day", "kind", "note")
    sign = F.col("by_group") & F.col("kind").isin("owner", "body_in")
    firsts = facts.groupBy("company_id").agg(
        F.min(F.when(F.col("kind") == "incorporated", F.col("day"))).alias("founded"),
        F.min_by(F.when(F.col("by_group") & (F.col("kind") == "owner"), fact), F.when(F.col("by_group") & (F.col("kind") == "owner"), order)).alias("owner"),
        F.min_by(F.when(sign, fact), F.when(sign, order)).alias("sign"),
    )
    signs = firsts.select("company_id", F.col("sign.day").alias("sign_day"))
    out = facts.join(signs, "company_id").groupBy("company_id").agg(
        F.min(F.when((F.col("kind") == "body_out") & ~F.col("by_group"), F.abs(F.datediff("day", "sign_day")))).alias("handover"),
        F.max((F.col("kind") == "owner") & ~F.col("by_group") & (F.col("day") < F.col("sign_day"))).alias("outside_owner"),
        F.max((F.col("kind") == "incorporated") & (F.col("day") < F.col("sign_day"))).alias("founded_before"),
    )
    return firsts.join(out, "company_id")


def _code(fact: Column) -> Column:
    return F.concat(F.when(fact["kind"] == "owner", "owner:").otherwise("officer:"), fact["day"].cast("string"), F.lit(":"), fact["note"])


def date_entries(members: DataFrame, facts: DataFrame, first_gazette: Column) -> DataFrame:
    """(company_id, rule, entry_day, evidence, confirmed, year, proof): the first rule that
    applies of head, founded, acquired, untied, listed and already_in."""
    m = members.join(entry_facts(facts), "company_id", "left")
    sign, owner, founded = F.col("sign"), F.col("owner"), F.col("founded")
    has_sign = sign.isNotNull()
    born = has_sign & founded.isNotNull() & (F.datediff(sign["day"], founded) <= C.BORN_DAYS)
    by_owner = F.coalesce(F.datediff(owner["day"], founded) <= C.BORN_DAYS, F.lit(False))
    hands = has_sign & (F.coalesce(F.col("outside_owner"), F.lit(False)) | F.coalesce(F.col("founded_before"), F.lit(False)) | F.coalesce(F.col("handover") <= C.HANDOVER_DAYS, F.lit(False)))
    listed = has_sign & F.coalesce(F.col("incorporated") >= first_gazette, F.lit(False))
    rule = F.when(F.col("is_head"), "head").when(born, "founded").when(hands, "acquired").when(~has_sign, "untied").when(listed, "listed").otherwise("already_in")
    m = m.withColumn("rule", rule)
    day = (
        F.when(F.col("rule") == "head", F.coalesce("incorporated", "founded"))
        .when(F.col("rule") == "founded", founded)
        .when(F.col("rule") == "acquired", sign["day"])
        .when(F.col("rule") == "listed", F.col("incorporated"))
    )
    owner_sign = sign["kind"] == "owner"
    evidence = (
        F.when((F.col("rule").isin("head", "listed")) & F.col("entry_day").isNotNull(), "incorporation")
        .when(F.col("rule") == "founded", F.when(by_owner, "owner").otherwise("officers"))
        .when(F.col("rule") == "acquired", F.when(owner_sign, "owner").otherwise("officers"))
    )
    confirmed = (
        F.when(F.col("rule") == "head", F.col("incorporated").isNull() & founded.isNotNull())
        .when(F.col("rule") == "founded", by_owner)
        .when(F.col("rule") == "acquired", owner_sign)
        .otherwise(False)
    )
    proof = F.when(F.col("rule") == "founded", F.when(by_owner, _code(owner)).otherwise(_code(sign))).when(F.col("rule").isin("acquired", "listed"), _code(sign)).when(F.col("rule") == "already_in", F.concat(F.lit("group_from:"), sign["day"].cast("string"))).when(F.col("rule") == "untied", "no_group_act")
    m = m.withColumn("entry_day", day).withColumn("proof", proof).withColumn("confirmed", F.coalesce(confirmed, F.lit(False))).withColumn("_e", evidence)
    known = F.col("entry_day").isNotNull() & F.col("_e").isNotNull()
    fallback = F.coalesce("incorporated", "founded")
    return m.select(
        "company_id", "rule", "entry_day",
        F.when(known, F.col("_e")).when(fallback.isNotNull(), "incorporation").alias("evidence"),
        F.when(known, F.col("confirmed")).otherwise(False).alias("confirmed"),
        F.when(known, F.year("entry_day")).otherwise(F.year(fallback)).alias("year"), "proof",
    )


def tie_to_group(slots: DataFrame, bodies: DataFrame) -> DataFrame:
    """(company_id, group_id, tie): how a candidate is tied to its group.

    ``slots``: (company_id, group_id, day, at, kind) of owners and absorbed companies that
    are members; ``bodies``: (company_id, group_id, day, at, role, opens) of member companies
    on its body.  The first owner, absorption or sole directorship counts; a seat on the
    body only if there is none of these."""
    strong = slots.filter(F.col("kind").isin("owned_by", "absorbs")).select("company_id", "group_id", "day", "at", F.col("kind").alias("tie"))
    strong = strong.unionByName(bodies.filter("role = 'sole_director' and opens").select("company_id", "group_id", "day", "at", F.lit("run_by").alias("tie")))
    weak = bodies.filter("not (role = 'sole_director' and opens)").select("company_id", "group_id", "day", "at", F.lit("on_body").alias("tie"))
    every = strong.withColumn("w", F.lit(0)).unionByName(weak.withColumn("w", F.lit(1)))
    return every.groupBy("company_id", "group_id").agg(F.min_by("tie", F.struct("w", "day", "at")).alias("tie"))


def belongs(tie: Column) -> Column:
    return tie.isin("owned_by", "absorbs", "run_by")


def earlier_hands(facts: DataFrame) -> DataFrame:
    """(company_id, codes): why a company was someone else's before the group's first sign,
    as an array: each outside owner by day, then its incorporation, then the days to the
    nearest outsider that left its body, if they are few.  Companies without a sign have
    no row.  ``facts`` as for ``entry_facts``."""
    rules = entry_facts(facts).filter("sign is not null").select("company_id", F.col("sign.day").alias("sign_day"), "handover")
    before = facts.join(rules.select("company_id", "sign_day"), "company_id").filter(F.col("day") < F.col("sign_day"))
    outside = (F.col("kind") == "owner") & ~F.col("by_group")
    told = before.groupBy("company_id").agg(
        F.array_sort(F.collect_list(F.when(outside, F.struct("day", "at")))).alias("owners"),
        F.min(F.when(F.col("kind") == "incorporated", F.col("day"))).alias("founded"),
    )
    j = rules.join(told, "company_id", "left")
    owners = F.transform(F.coalesce("owners", F.array()), lambda x: F.concat(F.lit("outside_owner:"), x["day"].cast("string")))
    one = lambda test, code: F.when(test, F.array(code)).otherwise(F.array().cast("array<string>"))
    founded = one(F.col("founded").isNotNull(), F.concat(F.lit("founded_before:"), F.col("founded").cast("string")))
    left = one(F.coalesce(F.col("handover") <= C.HANDOVER_DAYS, F.lit(False)), F.concat(F.lit("handover:"), F.col("handover").cast("string"), F.lit("d")))
    return j.select("company_id", F.concat(owners, founded, left).alias("codes"))
