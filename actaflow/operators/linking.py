"""Links of announcements to companies, kept up to date as documents come, change and go.

What is learned (sheets by name, aliases by renames) is kept with the pass in which a
rebuild would learn it and with the announcement that taught it.  A change of documents
makes some keys doubtful: the sheets and names that its announcements could have taught,
and, forward along the announcements at hand, those that doubtful keys could have taught
in turn.  Doubtful keys are forgotten and derived once more, pass by pass, beside the
others, which stay as they are with their passes.  The result is that of a rebuild,
whatever the order in which the documents came, so years can be swept in any order.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actaflow.functions import catalogue as C
from actaflow.operators.matching import exact_match, name_index
from actaflow.operators.tables import cut_lineage, first_by

FACT = ("doc_id", "num", "province", "sheet", "firm_key", "fact_day", "ends_sheet", "new_keys")
SHEET, NAME = ("province", "sheet"), ("name_key",)
_TEACHER = ("company_id", "pass", "doc_id", "num")


class Base(NamedTuple):
    """What is known beforehand: watched (company_id, name_key, incorporated), sheets
    (province, sheet, company_id) and aliases (name_key, company_id)."""

    watched: DataFrame
    sheets: DataFrame
    aliases: DataFrame
    guard_days: int = C.GUARD_DAYS


class Linked(NamedTuple):
    """Announcements at hand, what they taught, and their links: facts (FACT), sheets and
    aliases (key, company_id, pass, doc_id, num), links (doc_id, num, company_id, via, suggestion)."""

    facts: DataFrame
    sheets: DataFrame
    aliases: DataFrame
    links: DataFrame


def facts_of(announcements: DataFrame, renames: DataFrame) -> DataFrame:
    """Facts of announcements (doc_id, num, province, sheet, firm_key, fact_day, ends_sheet)
    and their renames (doc_id, num, new_key)."""
    other = renames.filter("new_key <> ''").groupBy("doc_id", "num").agg(F.array_sort(F.collect_set("new_key")).alias("new_keys"))
    joined = announcements.join(other, ["doc_id", "num"], "left")
    return joined.withColumn("new_keys", F.coalesce("new_keys", F.array().cast("array<string>"))).select(*FACT)


def _sheet_targets(facts: DataFrame) -> DataFrame:
    return facts.filter("sheet is not null and not ends_sheet").select(*SHEET)


def _name_targets(facts: DataFrame) -> DataFrame:
    both = facts.filter("size(new_keys) > 0").select(F.explode(F.concat(F.array("firm_key"), F.col("new_keys"))).alias("name_key"))
    return both.filter("name_key <> ''")


def _without(keys: DataFrame, *taken: DataFrame) -> DataFrame:
    columns = keys.columns
    for other in taken:
        keys = keys.join(other.select(*columns), columns, "left_anti")
    return keys.distinct()


def _on(facts: DataFrame, sheets: DataFrame, names: DataFrame) -> DataFrame:
    """Facts on one of the sheets or under one of the names, each once."""
    on_sheet = facts.join(sheets.select(*SHEET), [*SHEET], "left_semi").select(*FACT)
    under = facts.join(names.select(F.col("name_key").alias("firm_key")), "firm_key", "left_semi").select(*FACT)
    return on_sheet.unionByName(under.join(sheets.select(*SHEET), [*SHEET], "left_anti").select(*FACT))


def _kept(sheets: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after one checkpoint."""
    both = cut_lineage(sheets.unionByName(names, allowMissingColumns=True))
    return both.filter("name_key is null").select(*sheets.columns), both.filter("name_key is not null").select(*names.columns)


def _doubtful(facts: DataFrame, changed: DataFrame, base: Base) -> tuple[DataFrame, DataFrame]:
    """Sheets and names whose teacher may be another one after a change."""
    owned = cut_lineage(name_index(base.watched, base.aliases).select("name_key"))
    sheets, names = _kept(_without(_sheet_targets(changed), base.sheets), _without(_name_targets(changed), owned))
    new_sheets, new_names = sheets, names
    while not (new_sheets.isEmpty() and new_names.isEmpty()):
        reached = cut_lineage(_on(facts, new_sheets, new_names))
        under = reached.join(new_names.select(F.col("name_key").alias("firm_key")), "firm_key", "left_semi")
        new_sheets, new_names = _kept(_without(_sheet_targets(under), base.sheets, sheets), _without(_name_targets(reached), owned, names))
        sheets, names = sheets.unionByName(new_sheets), names.unionByName(new_names)
    return sheets, names


def _derive(facts: DataFrame, base: Base, sheets: DataFrame, aliases: DataFrame, open_sheets: DataFrame | None, open_names: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """What ``facts`` teach about the open keys (None: about all), beside the ``sheets`` and
    ``aliases`` that stand with their passes.

    A pass sees what was learned in the passes before it.  After the first one it reads
    only announcements that something new is known about: no others can match now that did
    not before."""
    spark = facts.sparkSession
    empty = lambda keys: spark.createDataFrame([], f"{', '.join(f'{k} string' for k in keys)}, company_id long, pass int, doc_id string, num long")
    new_sheets, new_names = empty(SHEET), empty(NAME)
    standing = sheets.select("pass").unionByName(aliases.select("pass")).agg(F.coalesce(F.max("pass"), F.lit(0))).first()[0]
    n, touched = 0, facts
    while True:
        n += 1
        seen_sheets, seen_names = sheets.filter(F.col("pass") < n).unionByName(new_sheets), aliases.filter(F.col("pass") < n).unionByName(new_names)
        known = base.sheets.select(*SHEET, "company_id").unionByName(seen_sheets.select(*SHEET, "company_id"))
        names = base.aliases.select("name_key", "company_id").unionByName(seen_names.select("name_key", "company_id"))
        linked = cut_lineage(exact_match(touched, base.watched, known, names, base.guard_days).filter("company_id is not null").select(*FACT, "via", "company_id"))
        taught = linked.filter("via = 'name' and sheet is not null and not ends_sheet").join(known, [*SHEET], "left_anti")
        both = linked.filter("size(new_keys) > 0").withColumn("name_key", F.explode(F.concat(F.array("firm_key"), F.col("new_keys")))).filter("name_key <> ''")
        fresh = both.join(name_index(base.watched, names).select("name_key"), "name_key", "left_anti")
        if open_sheets is not None:
            taught, fresh = taught.join(open_sheets, [*SHEET], "left_semi"), fresh.join(open_names, "name_key", "left_semi")
        order = ["fact_day", "doc_id", "num"]
        taught = first_by(taught.select(*SHEET, "company_id", *order), [*SHEET], order).withColumn("pass", F.lit(n))
        fresh = first_by(fresh.select("name_key", "company_id", *order), ["name_key"], order).withColumn("pass", F.lit(n))
        taught, fresh = _kept(taught.select(*SHEET, *_TEACHER), fresh.select("name_key", *_TEACHER))
        if n > standing and taught.isEmpty() and fresh.isEmpty():
            return new_sheets, new_names
        new_sheets, new_names = new_sheets.unionByName(taught), new_names.unionByName(fresh)
        now = F.col("pass") == n
        touched = _on(facts, taught.unionByName(sheets.filter(now)), fresh.unionByName(aliases.filter(now)))


def _links(facts: DataFrame, base: Base, sheets: DataFrame, aliases: DataFrame) -> DataFrame:
    known = base.sheets.select(*SHEET, "company_id").unionByName(sheets.select(*SHEET, "company_id"))
    names = base.aliases.select("name_key", "company_id").unionByName(aliases.select("name_key", "company_id"))
    found = exact_match(facts, base.watched, known, names, base.guard_days)
    return found.filter("company_id is not null or suggestion is not null").select("doc_id", "num", "company_id", "via", "suggestion")


def link_all(facts: DataFrame, base: Base) -> Linked:
    """The state after a rebuild from all facts."""
    facts = cut_lineage(facts.select(*FACT))
    none = facts.sparkSession.createDataFrame([], "pass int")
    sheets, aliases = _derive(facts, base, none.selectExpr("'' province", "'' sheet", "0L company_id", "pass", "'' doc_id", "0L num"), none.selectExpr("'' name_key", "0L company_id", "pass", "'' doc_id", "0L num"), None, None)
    return Linked(facts, sheets, aliases, cut_lineage(_links(facts, base, sheets, aliases)))


def apply_changes(state: Linked, base: Base, inserted: DataFrame, withdrawn: DataFrame | None = None) -> Linked:
    """The state after documents came, changed or went.

    ``inserted``: facts; a document that was at hand is replaced as a whole.  ``withdrawn``:
    (doc_id).  Announcements that a replacement leaves as they were change nothing.  The
    facts of the new state read those of the old one; ``compacted`` cuts that chain."""
    inserted = cut_lineage(inserted.select(*FACT))
    gone = inserted.select("doc_id") if withdrawn is None else inserted.select("doc_id").unionByName(withdrawn.select("doc_id"))
    gone = cut_lineage(gone.distinct())
    removed = cut_lineage(state.facts.join(gone, "doc_id", "left_semi").select(*FACT))
    facts = state.facts.join(gone, "doc_id", "left_anti").select(*FACT).unionByName(inserted)
    changed = cut_lineage(removed.exceptAll(inserted).unionByName(inserted.exceptAll(removed)))
    doubtful_sheets, doubtful_names = _doubtful(facts, changed, base)
    standing_sheets = state.sheets.join(doubtful_sheets, [*SHEET], "left_anti").select(*SHEET, *_TEACHER)
    standing_sheets, standing_names = _kept(standing_sheets, state.aliases.join(doubtful_names, "name_key", "left_anti").select("name_key", *_TEACHER))
    # what can teach a doubtful key: announcements on its sheet, and renames from or to its name
    renames = facts.filter("size(new_keys) > 0").withColumn("_key", F.explode(F.concat(F.array("firm_key"), F.col("new_keys"))))
    renames = renames.join(doubtful_names.withColumnRenamed("name_key", "_key"), "_key", "left_semi").select(*FACT).distinct()
    teachers = facts.join(doubtful_sheets, [*SHEET], "left_semi").select(*FACT)
    teachers = cut_lineage(teachers.unionByName(renames.join(doubtful_sheets, [*SHEET], "left_anti").select(*FACT)))
    new_sheets, new_names = _derive(teachers, base, standing_sheets, standing_names, doubtful_sheets, doubtful_names)
    sheets, aliases = _kept(standing_sheets.unionByName(new_sheets), standing_names.unionByName(new_names))
    # links change where a key has another owner, and with the announcements themselves
    moved_sheets, moved_names = _kept(_moved(state.sheets, sheets, SHEET), _moved(state.aliases, aliases, NAME))
    stale = cut_lineage(_on(facts, moved_sheets, moved_names).unionByName(inserted).distinct())
    old = state.links.join(gone, "doc_id", "left_anti").join(stale.select("doc_id", "num").distinct(), ["doc_id", "num"], "left_anti")
    links = old.select("doc_id", "num", "company_id", "via", "suggestion").unionByName(_links(stale, base, sheets, aliases))
    return Linked(facts, sheets, aliases, cut_lineage(links))


def _moved(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys that have another owner, or none any more, or one now."""
    a, b = old.select(*keys, "company_id"), new.select(*keys, "company_id")
    return a.exceptAll(b).unionByName(b.exceptAll(a)).select(*keys).distinct()


def compacted(state: Linked) -> Linked:
    return state._replace(facts=cut_lineage(state.facts))


def sweep(state: Linked, base: Base, facts: DataFrame, ranges: list[tuple]) -> tuple[Linked, DataFrame]:
    """The state after the facts of each (first, last) day range, one range after the other,
    and the report of the passes: (step, first, last, sheets, aliases, links), what each
    range added in all years so far.  A range may be swept again when its documents changed;
    one that adds nothing reports zeros."""
    spark, rows = facts.sparkSession, []
    sizes = lambda s: (s.sheets.count(), s.aliases.count(), s.links.filter("company_id is not null").count())
    before = sizes(state)
    for step, (first, last) in enumerate(ranges, 1):
        state = compacted(apply_changes(state, base, facts.filter(F.col("fact_day").between(F.lit(first), F.lit(last)))))
        after = sizes(state)
        rows.append((step, first, last, *(b - a for a, b in zip(before, after))))
        before = after
    return state, spark.createDataFrame(rows, "step int, first date, last date, sheets long, aliases long, links long")
