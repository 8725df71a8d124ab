"""The steps of keeping announcements: cascade, derived rows, leads and their upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actaflow.functions import catalogue as C
from actaflow.functions.text import name_key
from actaflow.operators.facts import observations
from actaflow.operators.tables import first_by


def followed_sheets(leads: DataFrame) -> DataFrame:
    """(province, sheet, lead_id): sheets of open leads found by mention, the earliest lead."""
    return leads.filter("state = 'open' and found_by = 'mention' and sheet is not null").groupBy("province", "sheet").agg(F.min("lead_id").alias("lead_id"))


def cascade(matched: DataFrame, followed: DataFrame, found: DataFrame | None = None, store_all: bool = False, known_only: bool = False) -> DataFrame:
    """Where each announcement is kept: the first of watched, review, followed lead, discovery,
    all, discard that applies.  ``known_only`` (later passes) leaves out review and discovery.
    """
    a = matched.join(followed.withColumnRenamed("lead_id", "_followed"), ["province", "sheet"], "left")
    if found is not None and not known_only:
        a = a.join(found.select("doc_id", "num", F.col("group_id").alias("lead_group"), "reason", "evidence").withColumnRenamed("reason", "signal"), ["doc_id", "num"], "left")
    else:
        a = a.withColumns({"lead_group": F.lit(None).cast("long"), "signal": F.lit(None).cast("string"), "evidence": F.lit(None).cast("string")})
    kept = F.when(F.col("company_id").isNotNull(), "watched")
    if not known_only:
        kept = kept.when(F.col("suggestion").isNotNull(), "review")
    kept = kept.when(F.col("_followed").isNotNull(), "candidate")
    if not known_only:
        kept = kept.when(F.col("signal").isNotNull(), "candidate")
        if store_all:
            kept = kept.when(F.lit(True), "all")
    # a link clears what else the announcement was kept for
    free = F.col("company_id").isNull()
    return a.withColumns({"kept_as": kept.otherwise("discard"), "lead_id": F.when(free, F.col("_followed")), "suggestion": F.when(free, F.col("suggestion"))}).drop("_followed")


def tallies(kept: DataFrame) -> DataFrame:
    """Everything is counted, even what is discarded."""
    return kept.groupBy("kept_as").agg(F.count(F.lit(1)).alias("n"))


def derive_values(acts: DataFrame, links: DataFrame) -> DataFrame:
    """Observations of linked announcements, once for each (doc_id, company, field, day, value):
    the last in the document, as of two values of one day the last one holds."""
    a = acts.join(links.select("doc_id", "num", "company_id"), ["doc_id", "num"])
    o = a.select("company_id", "doc_id", "num", F.col("fact_day").alias("day"), F.explode(F.array(observations(F.col("act_type"), F.col("detail")))).alias("_o"))
    o = o.select("company_id", "doc_id", "num", "day", F.explode("_o").alias("o"))
    return first_by(o.select("company_id", "doc_id", "num", "day", "o.field", "o.value"), ["doc_id", "company_id", "field", "day", "value"], [-F.col("num")]).withColumn("source", F.lit("registry"))


def derive_events(holdings: DataFrame, links: DataFrame) -> DataFrame:
    """Officer events of linked announcements, once for each (doc, num, holder, role, kind)."""
    kind = F.lit(None).cast("string")
    for act, event in C.EVENT_OF_ACT.items():
        kind = F.when(F.col("act_type") == act, F.lit(event)).otherwise(kind)
    e = holdings.join(links.select("doc_id", "num", "company_id"), ["doc_id", "num"]).withColumn("kind", kind)
    return first_by(e, ["doc_id", "num", "holder_plain", "role", "kind"], ["seq", "pos"])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Old rows, and the first new row of each key that is not there yet (null keys compare equal)."""
    fresh = first_by(new, keys, order)
    condition = F.lit(True)
    for k in keys:
        condition = condition & old[k].eqNullSafe(fresh[k])
    return old.unionByName(fresh.join(old, condition, "left_anti").select(*old.columns))


def refresh_leads(leads: DataFrame, notices: DataFrame) -> DataFrame:
    """Counts and days of each lead from its announcements; kept as they were if it has none."""
    n = notices.filter("lead_id is not null").groupBy("lead_id").agg(F.count(F.lit(1)).alias("_n"), F.min("fact_day").alias("_a"), F.max("fact_day").alias("_b"))
    j = leads.join(n, "lead_id", "left")
    return j.withColumns({"notice_count": F.coalesce("_n", "notice_count"), "first_day": F.coalesce("_a", "first_day"), "last_day": F.coalesce("_b", "last_day")}).drop("_n", "_a", "_b")


def rejudge(leads: DataFrame, watched_keys: DataFrame, watched_sheets: DataFrame, found: DataFrame) -> DataFrame:
    """Leads judged again: watched if the company is by now, open if a signal fires, whose
    group, signal and evidence replace the old ones, else gone.  ``found``: (lead_id,
    group_id, reason, evidence)."""
    j = leads.join(watched_keys.select(F.col("name_key").alias("firm_key"), F.lit(True).alias("_name")).distinct(), "firm_key", "left")
    j = j.join(watched_sheets.select("province", "sheet", F.lit(True).alias("_sheet")).distinct(), ["province", "sheet"], "left")
    f = found.select("lead_id", F.col("group_id").alias("_g"), F.col("reason").alias("_r"), F.col("evidence").alias("_e"))
    j = j.join(f, "lead_id", "left")
    is_watched = F.col("_name").isNotNull() | F.col("_sheet").isNotNull()
    fires = F.col("_r").isNotNull() & ~is_watched
    return j.withColumns(
        {
            "state": F.when(is_watched, "watched").when(fires, "open").otherwise("gone"),
            "group_id": F.when(fires, F.col("_g")).otherwise(F.col("group_id")),
            "found_by": F.when(fires, F.col("_r")).otherwise(F.col("found_by")),
            "evidence": F.when(fires, F.col("_e")).otherwise(F.col("evidence")),
        }
    ).select(*leads.columns)


def stored_counts(documents: DataFrame, notices: DataFrame) -> DataFrame:
    """(doc_id, stored): kept announcements of each document, 0 if none."""
    n = notices.groupBy("doc_id").agg(F.count(F.lit(1)).alias("stored"))
    return documents.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("stored", F.lit(0)).alias("stored"))


def sweep_counts(notices: DataFrame, sheets: DataFrame, aliases: DataFrame, leads: DataFrame) -> dict[str, int]:
    """What a pass is judged by: it added something if one of the first four has grown."""
    n = notices.agg(F.count_if(F.col("company_id").isNotNull()).alias("watched"), F.count_if(F.col("lead_id").isNotNull()).alias("of_leads"), F.count_if(F.col("suggestion").isNotNull()).alias("review"), F.count(F.lit(1)).alias("kept")).first()
    return {"sheets": sheets.count(), "aliases": aliases.count(), **n.asDict(), "leads": leads.count()}


def added_anything(before: dict[str, int], after: dict[str, int]) -> bool:
    return any(after[k] > before[k] for k in ("sheets", "aliases", "watched", "of_leads"))


def import_watchlist(watched: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries over watched companies by name key: the stored display name stays, and a
    field of the record is only filled where nothing is known yet."""
    start = F.lit((watched.agg(F.max("company_id")).first()[0] or 0))
    e = entries.select("name_key", F.col("name").alias("_name"), F.col("group").alias("_group"), *[F.col(f).cast("string").alias(f"_{f}") for f in ("address", "city", "capital", "purpose", "status")], F.col("incorporated").alias("_incorporated"), F.col("head").alias("_head"))
    j = watched.join(e, "name_key", "full")
    from pyspark.sql import Window

    fresh = F.row_number().over(Window.partitionBy(F.col("company_id").isNull()).orderBy("name_key"))
    fields = {f: F.coalesce(F.col(f), F.col(f"_{f}").cast(watched.schema[f].dataType)) for f in ("address", "city", "capital", "purpose", "status")}
    j = j.withColumns({"company_id": F.coalesce("company_id", (start + fresh).cast("long")), "name": F.coalesce("name", "_name"), "incorporated": F.coalesce("_incorporated", "incorporated"), "is_head": F.coalesce("_head", "is_head"), "group": F.coalesce("_group", "group"), **fields})
    return j.select(*watched.columns)


def joined_changes(watched: DataFrame, dated: DataFrame) -> DataFrame:
    """(company_id, year, evidence, confirmed) that differ from what is stored, except years
    that a person typed."""
    s = watched.select("company_id", "joined_year", "joined_evidence", "joined_confirmed", "joined_manual")
    d = dated.join(s, "company_id")
    same = F.col("year").eqNullSafe(F.col("joined_year")) & F.col("evidence").eqNullSafe(F.col("joined_evidence")) & F.col("confirmed").eqNullSafe(F.col("joined_confirmed"))
    return d.filter(~F.col("joined_manual") & ~same).select("company_id", "year", "evidence", "confirmed")


def officer_names(events: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct (holder_plain, group_id) of natural persons of the watched companies."""
    return events.filter("not is_company").join(members.select("company_id", "group_id"), "company_id").select("holder_plain", "group_id").distinct()


def watched_names(watched: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, company_id): names, then aliases."""
    return watched.select("name", "company_id").unionByName(aliases.select("name", "company_id"))


def watched_addresses(watched: DataFrame, now: DataFrame) -> DataFrame:
    """Distinct (street, city, company_id): as listed and as the record has them."""
    pairs = now.filter(F.col("field").isin("address", "city")).groupBy("company_id").agg(F.max(F.when(F.col("field") == "address", F.col("value"))).alias("street"), F.max(F.when(F.col("field") == "city", F.col("value"))).alias("city"))
    listed = watched.select(F.col("address").alias("street"), "city", "company_id")
    return listed.unionByName(pairs.select("street", "city", "company_id")).filter("street is not null and city is not null").distinct()


def group_keys(members: DataFrame) -> DataFrame:
    """(group_id, key, company_id): a group's names, in full and (four characters or more)
    without their form; the first company of a key keeps it, full names first."""
    from actaflow.functions.text import split_form

    m = members.withColumn("full", name_key(F.col("name")))
    base = split_form(F.col("full"))["base"]
    k = m.select("group_id", "company_id", F.posexplode(F.filter(F.array(F.col("full"), F.when(F.char_length(base) >= C.BARE_MIN_CHARS, base)), lambda x: x.isNotNull() & (x != ""))).alias("rank", "key"))
    return first_by(k, ["group_id", "key"], ["rank", "company_id"]).select("group_id", "key", "company_id")


def clear_derived(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What a rebuild starts from: the watchlist and what came with it, and the days on
    which there was no gazette.  ``tables`` may hold values (source), sheets (how), aliases
    (added_by) and days (status); derived tables among the others become empty."""
    kept = {"values": "source = 'watchlist'", "sheets": "how = 'listed'", "aliases": "added_by = 'watchlist'", "days": "status not in ('published', 'failed')", "watched": "true"}
    return {name: df.filter(kept.get(name, "false")) for name, df in tables.items()}


def unread(documents: DataFrame, read: DataFrame) -> DataFrame:
    """Documents that no earlier pass has read, by doc_id; one without an id is unread."""
    return documents.join(read.select("doc_id").distinct(), "doc_id", "left_anti").select(*documents.columns)


def group_labels(members: DataFrame) -> DataFrame:
    """(group_id, group): the label of each group, one row a group."""
    return members.filter("group_id is not null").groupBy("group_id").agg(F.min("group").alias("group"))


def find_members(names: DataFrame, keys: DataFrame) -> DataFrame:
    """``names`` (group_id, name) with found, the company of the group that a name is: by its
    full key, else by the key without its form.  ``keys`` as of ``group_keys``."""
    from actaflow.functions.text import split_form

    asked = names.select("*", F.explode(F.array(name_key(F.col("name")))).alias("_full"))
    asked = asked.withColumn("_bare", split_form(F.col("_full"))["base"])
    by = lambda c: keys.select(F.col("group_id").alias("_g"), F.col("key").alias(f"_k{c}"), F.col("company_id").alias(c))
    for key, c in (("_full", "_by_full"), ("_bare", "_by_bare")):
        asked = asked.join(by(c), (F.col("group_id") == F.col("_g")) & (F.col(key) == F.col(f"_k{c}")) & (F.col("_full") != ""), "left").drop("_g", f"_k{c}")
    return asked.select(*names.columns, F.coalesce("_by_full", "_by_bare").alias("found"))
