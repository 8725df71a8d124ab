"""The company record: dated values to what holds today, and what should be written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actaflow.functions import catalogue as C
from actaflow.functions.places import differs
from actaflow.operators.tables import numbered



def _stage(value):
    out = F.lit(0)
    for i, status in enumerate(C.LIFECYCLE, 1):
        out = F.when(value == status, F.lit(i)).otherwise(out)
    return out


def outlived(values: DataFrame, notices: DataFrame) -> DataFrame:
    """Statuses that later facts overrule: an ``extinct`` with any later notice of the
    company, and a ``dissolved`` of the same day as such an ``extinct``."""
    status = values.filter("field = 'status' and source = 'registry'")
    last = notices.filter("company_id is not null").groupBy("company_id").agg(F.max("fact_day").alias("_last"))
    extinct = status.filter("value = 'extinct'").join(last, "company_id").filter("_last > day").drop("_last")
    same_day = extinct.select("company_id", "day").distinct()
    dissolved = status.filter("value = 'dissolved'").join(same_day, ["company_id", "day"], "left_semi")
    return extinct.select(*values.columns).unionByName(dissolved.select(*values.columns))


def record_now(values: DataFrame, notices: DataFrame) -> DataFrame:
    """The value of each (company, field): any of the registry before any of the watchlist,
    then the latest day, on one day the later stage of a company's life, then the last row
    (doc_id, num)."""
    left = values.join(outlived(values, notices).select("company_id", "field", "day", "value", "source").distinct(), ["company_id", "field", "day", "value", "source"], "left_anti")
    best = F.max_by(
        F.struct(*[c for c in values.columns if c not in ("company_id", "field")]),
        F.struct((F.col("source") == "registry").alias("a"), F.col("day").alias("b"), F.when(F.col("field") == "status", _stage(F.col("value"))).otherwise(0).alias("c"), F.coalesce("doc_id", F.lit("")).alias("d"), F.coalesce("num", F.lit(0)).alias("e")),
    )
    return left.groupBy("company_id", "field").agg(best.alias("v")).select("company_id", "field", "v.*")


def held_values(watched: DataFrame) -> DataFrame:
    """(company_id, field, held): the record's columns, one row each."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("held")) for f in C.RECORD_FIELDS])
    return watched.select("company_id", F.explode(pairs).alias("p")).select("company_id", "p.*")


def proposals(watched: DataFrame, now: DataFrame, log: DataFrame) -> DataFrame:
    """(why, company_id, field, held, proposed, day, doc_id, num): what should be written.

    ``registry``: the registry says something else.  ``unbacked``: a value written before
    has no observation of the registry left, and the record still holds it."""
    held, registry = held_values(watched), now.filter("source = 'registry'")
    wanted = registry.join(held, ["company_id", "field"]).filter(differs(F.col("field"), F.col("held"), F.col("value")))
    wanted = wanted.select(F.lit("registry").alias("why"), "company_id", "field", "held", F.col("value").alias("proposed"), "day", "doc_id", "num")
    last = log.filter("state = 'applied'").groupBy("company_id", "field").agg(F.max_by(F.struct("replaced", "written", "fact_day", "doc_id", "num"), "entry_id").alias("l"))
    back = last.join(registry, ["company_id", "field"], "left_anti").join(held, ["company_id", "field"])
    back = back.filter(~differs(F.col("field"), F.col("held"), F.col("l.written")))
    back = back.select(F.lit("unbacked").alias("why"), "company_id", "field", "held", F.coalesce("l.replaced", F.lit("")).alias("proposed"), F.col("l.fact_day").alias("day"), F.col("l.doc_id").alias("doc_id"), F.col("l.num").alias("num"))
    return wanted.unionByName(back)


def spelled_otherwise(watched: DataFrame, now: DataFrame) -> DataFrame:
    """Addresses and municipalities written otherwise that are the same place."""
    from actaflow.functions.text import plain

    both = now.filter("source = 'registry' and field in ('address', 'city')").join(held_values(watched), ["company_id", "field"])
    return both.filter((F.coalesce("held", F.lit("")) != "") & (plain(F.col("held")) != plain(F.col("value"))) & ~differs(F.col("field"), F.col("held"), F.col("value")))


def apply_proposals(watched: DataFrame, found: DataFrame) -> DataFrame:
    """The watched table with the proposals written; an empty text empties the field."""
    wide = found.groupBy("company_id").pivot("field", list(C.RECORD_FIELDS)).agg(F.first("proposed"))
    wide = wide.select("company_id", *[F.col(f).alias(f"_{f}") for f in C.RECORD_FIELDS])
    joined = watched.join(wide, "company_id", "left")
    new = {f: F.when(F.col(f"_{f}").isNull(), F.col(f)).otherwise(F.nullif(F.col(f"_{f}"), F.lit("")).cast(watched.schema[f].dataType)) for f in C.RECORD_FIELDS}
    return joined.withColumns(new).drop(*[f"_{f}" for f in C.RECORD_FIELDS])


def apply_log(log: DataFrame, found: DataFrame, at) -> DataFrame:
    """The log after writing: applied entries for the registry's values; those of a field
    that goes back are reverted."""
    back = found.filter("why = 'unbacked'").select("company_id", "field", F.lit(True).alias("_back"))
    old = log.join(back, ["company_id", "field"], "left").withColumn("state", F.when(F.col("_back") & (F.col("state") == "applied"), "reverted").otherwise(F.col("state"))).drop("_back")
    start = F.lit((log.agg(F.max("entry_id")).first()[0] or 0))
    new = numbered(found.filter("why = 'registry'"), [F.col("company_id"), F.col("field")], "_nth").select(
        (start + F.col("_nth")).alias("entry_id"), "company_id", "field",
        F.col("held").alias("replaced"), F.col("proposed").alias("written"), F.lit("applied").alias("state"), F.col("day").alias("fact_day"), "doc_id", "num",
    )
    return old.select(*new.columns).unionByName(new)
