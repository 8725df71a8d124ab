"""Announcements joined to watched companies: by sheet, by name, by closeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actaflow.functions import catalogue as C
from actaflow.functions.text import name_key, split_form
from actaflow.operators.tables import cut_lineage, first_by


def name_index(watched: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(name_key, company_id): watched names, then aliases; the first of a key keeps it and
    empty keys are refused."""
    names = watched.select("name_key", "company_id", F.lit(0).alias("rank"))
    if aliases is not None:
        names = names.unionByName(aliases.select("name_key", "company_id", F.lit(1).alias("rank")))
    return first_by(names.filter("name_key <> ''"), ["name_key"], ["rank", "company_id"]).select("name_key", "company_id")


def too_early(born: Column, when: Column, days: int = C.GUARD_DAYS) -> Column:
    """More than ``days`` before the company was incorporated: another company's act."""
    return F.coalesce(F.datediff(born, when) > days, F.lit(False))


def exact_match(announcements: DataFrame, watched: DataFrame, sheets: DataFrame, aliases: DataFrame | None = None, guard_days: int = C.GUARD_DAYS) -> DataFrame:
    """Adds company_id, via (sheet, name, none), suggestion, score and reason.

    The sheet's owner, unless it is too young; then the name; a name that is too young is
    a suggestion of 100.  Both sides are equi-joins, which Spark broadcasts if they are
    small."""
    born = watched.select("company_id", "incorporated")
    owner = sheets.select(F.col("province"), F.col("sheet"), F.col("company_id").alias("_owner")).join(born.withColumnRenamed("incorporated", "_owner_born").withColumnRenamed("company_id", "_owner"), "_owner", "left")
    named = name_index(watched, aliases).select(F.col("name_key").alias("firm_key"), F.col("company_id").alias("_named")).join(born.withColumnRenamed("incorporated", "_named_born").withColumnRenamed("company_id", "_named"), "_named", "left")
    a = announcements.join(owner, ["province", "sheet"], "left").join(named, "firm_key", "left")
    by_sheet = F.col("_owner").isNotNull() & ~too_early(F.col("_owner_born"), F.col("fact_day"), guard_days)
    young = too_early(F.col("_named_born"), F.col("fact_day"), guard_days)
    by_name = ~by_sheet & F.col("_named").isNotNull() & ~young
    suggested = ~by_sheet & F.col("_named").isNotNull() & young
    return a.withColumns(
        {
            "company_id": F.when(by_sheet, F.col("_owner")).when(by_name, F.col("_named")),
            "via": F.when(by_sheet, "sheet").when(by_name, "name").otherwise("none"),
            "suggestion": F.when(suggested, F.col("_named")),
            "score": F.when(suggested, 100.0).otherwise(0.0),
            "reason": F.when(suggested, "same name, published before incorporation").otherwise(""),
        }
    ).drop("_owner", "_owner_born", "_named", "_named_born")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, row by row of the usual table."""
    letters_a, letters_b = F.filter(F.split(a, ""), lambda c: c != ""), F.filter(F.split(b, ""), lambda c: c != "")
    zero = F.transform(letters_b, lambda _: F.lit(0))

    def row(previous: Column, x: Column) -> Column:
        cells = F.transform(letters_b, lambda y, i: F.struct((x == y).alias("same"), F.when(i > 0, F.get(previous, i - 1)).otherwise(0).alias("diagonal"), F.get(previous, i).alias("above")))
        step = lambda acc, c: F.concat(acc, F.array(F.when(c["same"], c["diagonal"] + 1).otherwise(F.greatest(c["above"], F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))))))
        return F.aggregate(cells, F.array().cast("array<int>"), step)

    return F.coalesce(F.try_element_at(F.aggregate(letters_a, zero, row), F.lit(-1)), F.lit(0))


def indel_ratio(a: Column, b: Column) -> Column:
    """200 LCS / (len a + len b)."""
    return F.lit(200.0) * lcs_length(a, b) / F.greatest(F.char_length(a) + F.char_length(b), F.lit(1))


def _trigrams(text: Column) -> Column:
    n = F.char_length(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3)))
    return F.array_distinct(grams)


def _shared_grams(total: Column, cutoff: float, n: int = 3) -> Column:
    """Whether names of ``total`` letters together, at the cutoff or above, must share a run
    of n letters.

    At a ratio r the longer has at least as many letters in common, in order, as r / 200 of
    the total; the other letters of both, at most (100 - r) / 100 of the total, part the
    common ones into at most one stretch more than there are of them."""
    apart = F.floor(total * (100 - cutoff) / 100)
    common = F.ceil(total * cutoff / 200)
    return common >= n + (n - 1) * apart


#: Names that differ in at most so many letters (left out or put in) meet by what is left of both
#: without these; other ones by trigrams or lengths.
DELETIONS = 3


def _without(text: Column, count: Column) -> Column:
    """What is left of a text without ``count`` of its letters (0 to DELETIONS), each text once."""

    def less(texts: Column) -> Column:
        one = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(t), F.lit(1))), lambda k: F.concat(F.substring(t, F.lit(1), k - 1), F.substring(t, k + 1, F.char_length(t))))
        return F.array_distinct(F.flatten(F.transform(texts, one)))

    left, out = F.array(text), F.lit(None).cast("array<string>")
    for i in range(DELETIONS + 1):
        out = F.when(count == i, left).otherwise(out)
        left = less(left)
    return out


def similar_names(names: DataFrame, watched: DataFrame, cutoff: float = C.FUZZY_CUTOFF) -> DataFrame:
    """(base, close, score): the best watched base of each distinct base, at the cutoff or
    above; ties go to the first watched one (by ``pos``).

    The lengths of two names and the cutoff bound the letters in which they may differ.
    Where these are few, names meet in an equi-join on what is left without them, which
    joins no other names, however many share their words.  Of longer ones those of which
    the cutoff leaves a run of three letters in common meet in an equi-join on trigrams;
    those for which it need not in one on their lengths.  ``levenshtein`` with a bound
    drops most of these, and only the rest is compared exactly."""
    left = cut_lineage(names.select("base").filter("base <> ''").distinct().withColumn("n", F.char_length("base")))
    right = cut_lineage(watched.select(F.col("base").alias("close"), "pos").filter("close <> ''").groupBy("close").agg(F.min("pos").alias("pos")).withColumn("m", F.char_length("close")))
    total = F.col("n") + F.col("m")
    # the sum of letters is no exact number; the score decides
    most = F.floor(total * (100 - cutoff) / 100 + F.lit(1e-9)).cast("int")
    lengths = left.select("n").distinct().crossJoin(right.select("m").distinct()).withColumn("most", most).filter(F.abs(F.col("n") - F.col("m")) <= F.col("most"))
    lengths = cut_lineage(lengths.withColumn("gone", F.floor((F.col("most") + F.col("n") - F.col("m")) / 2).cast("int")))

    few = lengths.filter(F.col("most") <= DELETIONS)
    shortened = lambda df, text, count: df.select("*", F.explode(F.array(_without(F.col(text), count))).alias("_r")).select("*", F.explode("_r").alias("rest")).drop("_r")
    here = shortened(left.join(few.select("n", "m", "gone"), "n"), "base", F.col("gone")).select("base", "n", "m", "rest")
    there = shortened(right.join(few.select("n", "m", "gone"), "m"), "close", F.col("gone") - F.col("n") + F.col("m")).select("close", "pos", "n", "m", "rest")
    by_rest = here.join(there, ["n", "m", "rest"]).select("base", "close", "pos", "n", "m").distinct()
    # they differ in three letters at most, so the shorter one lacks one letter of the other or none
    whole = F.levenshtein("base", "close") == F.abs(F.col("n") - F.col("m"))
    by_rest = by_rest.withColumn("score", F.lit(200.0) * (F.least("n", "m") - F.when(whole, 0).otherwise(1)) / total)

    more = lengths.filter(F.col("most") > DELETIONS).withColumn("sure", _shared_grams(total, cutoff))
    of = lambda df, n: df.join(more.filter("sure").select(n).distinct(), n, "left_semi")
    by_gram = of(left, "n").withColumn("gram", F.explode(_trigrams(F.col("base")))).join(of(right, "m").withColumn("gram", F.explode(_trigrams(F.col("close")))), "gram").select("base", "close", "pos", "n", "m").distinct()
    by_gram = by_gram.join(more.filter("sure").select("n", "m"), ["n", "m"], "left_semi").select("base", "close", "pos", "n", "m")
    by_length = left.join(more.filter("not sure").select("n", "m"), "n").join(right, "m").select("base", "close", "pos", "n", "m")
    pairs = by_gram.unionByName(by_length).filter(F.levenshtein("base", "close") <= most).withColumn("score", indel_ratio(F.col("base"), F.col("close")))
    pairs = pairs.unionByName(by_rest).filter(F.col("score") >= cutoff)
    return pairs.groupBy("base").agg(F.min_by(F.struct("close", "score"), F.struct((-F.col("score")).alias("s"), "pos")).alias("b")).select("base", "b.close", "b.score")


def match(announcements: DataFrame, watched: DataFrame, sheets: DataFrame, aliases: DataFrame | None = None, cutoff: float = C.FUZZY_CUTOFF, guard_days: int = C.GUARD_DAYS) -> DataFrame:
    """exact_match, and for what it leaves without a company or suggestion the closest name."""
    found = exact_match(announcements, watched, sheets, aliases, guard_days)
    found = found.withColumn("_open", F.col("company_id").isNull() & F.col("suggestion").isNull())
    index = name_index(watched, aliases)
    split = split_form(F.col("name_key"))
    bases = index.withColumn("base", split["base"]).withColumn("form", split["form"]).withColumn("pos", F.struct("company_id", "name_key"))
    firsts = first_by(bases, ["base"], ["pos"]).select(F.col("base").alias("_close"), F.col("company_id").alias("_near"), F.col("form").alias("_near_form"))
    # a name is split once, however many announcements print it
    keys = found.filter("_open").select("firm_key").distinct().select("firm_key", F.explode(F.array(split_form(F.col("firm_key")))).alias("_p"))
    keys = cut_lineage(keys.select("firm_key", F.col("_p.base").alias("_base"), F.col("_p.form").alias("_form")))
    best = similar_names(keys.select(F.col("_base").alias("base")), bases, cutoff).select(F.col("base").alias("_base"), F.col("close").alias("_close"), F.col("score").alias("_score"))
    near = cut_lineage(keys.join(best, "_base").join(firsts, "_close"))
    out = found.join(near, "firm_key", "left")
    hit = F.col("_open") & F.col("_close").isNotNull()
    none = lambda c: F.coalesce(F.col(c), F.lit("none"))
    why = F.when(F.col("_close") == F.col("_base"), F.concat(F.lit("same name, legal form "), none("_form"), F.lit(" vs "), none("_near_form"))).otherwise(F.concat(F.lit("similar name ("), F.format_number("_score", 1), F.lit(")")))
    return out.withColumns(
        {
            "suggestion": F.when(hit, F.col("_near")).otherwise(F.col("suggestion")),
            "score": F.when(hit, F.col("_score")).otherwise(F.col("score")),
            "reason": F.when(hit, why).otherwise(F.col("reason")),
        }
    ).drop("_open", "_base", "_form", "_close", "_score", "_near", "_near_form")


def learn(announcements: DataFrame, watched: DataFrame, sheets: DataFrame, aliases: DataFrame, renames: DataFrame, guard_days: int = C.GUARD_DAYS) -> tuple[DataFrame, DataFrame]:
    """Sheets and aliases after all that matches teach has been learned, in any order.

    A match by name teaches its sheet, unless the sheet is owned or an act ends it; a
    renamed company's other name becomes an alias, unless it is taken.  Of several
    companies that could teach one sheet in a pass, the earliest announcement decides
    (day, doc_id, num).  ``announcements`` has ends_sheet; ``renames`` doc_id, num,
    new_key.  Passes repeat until nothing is new, however long a chain of renames is;
    each adds a sheet or a name that none had, so they end.  A pass after the first
    reads only announcements on the sheets and under the names that the one before
    taught: no others can match now that did not before."""
    known, names = cut_lineage(sheets.select("province", "sheet", "company_id")), cut_lineage(aliases.select("name_key", "company_id"))
    facts = cut_lineage(announcements.select("doc_id", "num", "province", "sheet", "firm_key", "fact_day", "ends_sheet"))
    touched = facts
    while True:
        linked = cut_lineage(exact_match(touched, watched, known, names, guard_days).filter("company_id is not null").select("doc_id", "num", "province", "sheet", "firm_key", "fact_day", "via", "company_id", "ends_sheet"))
        taught = linked.filter("via = 'name' and sheet is not null and not ends_sheet").join(known, ["province", "sheet"], "left_anti")
        taught = first_by(taught.select("province", "sheet", "company_id", "fact_day", "doc_id", "num"), ["province", "sheet"], ["fact_day", "doc_id", "num"]).select("province", "sheet", "company_id")
        both = linked.join(renames, ["doc_id", "num"]).select("company_id", "fact_day", "doc_id", "num", F.explode(F.array("firm_key", "new_key")).alias("name_key"))
        taken = name_index(watched, names).select("name_key")
        fresh = first_by(both.filter("name_key <> ''").join(taken, "name_key", "left_anti"), ["name_key"], ["fact_day", "doc_id", "num"]).select("name_key", "company_id")
        taught, fresh = cut_lineage(taught), cut_lineage(fresh)
        if taught.isEmpty() and fresh.isEmpty():
            return known, names
        known, names = cut_lineage(known.unionByName(taught)), cut_lineage(names.unionByName(fresh))
        on_sheets = facts.join(taught.select("province", "sheet"), ["province", "sheet"], "left_semi")
        under_names = facts.join(fresh.select(F.col("name_key").alias("firm_key")), "firm_key", "left_semi").select(*facts.columns)
        touched = on_sheets.select(*facts.columns).unionByName(under_names).distinct()


def kept_as(company: Column, suggestion: Column, lead: Column) -> Column:
    """Where an announcement is kept: watched, review, lead or discarded."""
    return F.when(company.isNotNull(), "watched").when(suggestion.isNotNull(), "review").when(lead.isNotNull(), "lead").otherwise("discarded")


def relink(notices: DataFrame, sheets: DataFrame) -> DataFrame:
    """Kept, unmatched notices on a sheet that is owned by now: (doc_id, num, company_id)."""
    return notices.filter("company_id is null and sheet is not null").drop("company_id").join(sheets, ["province", "sheet"]).select("doc_id", "num", "company_id")


def prune(notices: DataFrame, leads: DataFrame) -> DataFrame:
    """Notices that are kept: with a company, under review, or of an open lead."""
    open_leads = leads.filter("state = 'open'").select("lead_id")
    rest = notices.filter("company_id is null and suggestion is null")
    return notices.filter("company_id is not null or suggestion is not null").unionByName(rest.join(open_leads, "lead_id", "left_semi").select(*notices.columns))


def upsert_notices(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows over old ones by (doc_id, num), never losing a match: a null in the new row
    keeps the old value, and what has a company is watched."""
    columns = [c for c in new.columns if c not in ("doc_id", "num", "kept_as")]
    joined = old.alias("o").join(new.alias("n"), ["doc_id", "num"], "full")
    merged = {c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) for c in columns}
    state = F.when(merged["company_id"].isNotNull(), "watched").otherwise(F.coalesce(F.col("n.kept_as"), F.col("o.kept_as")))
    return joined.select("doc_id", "num", *[v.alias(c) for c, v in merged.items()], state.alias("kept_as"))


def watched_lookup(names: DataFrame, watched: DataFrame, sheets: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``names`` (firm, province, sheet) with watched_id: the sheet's owner, else the company
    of the same name, without the guard on young companies and without suggestions."""
    asked = names.select("*", F.explode(F.array(name_key(F.col("firm")))).alias("_key"))
    owner = sheets.select(F.col("province"), F.col("sheet"), F.col("company_id").alias("_owner"))
    named = name_index(watched, aliases).select(F.col("name_key").alias("_key"), F.col("company_id").alias("_named"))
    found = asked.join(owner, ["province", "sheet"], "left").join(named, "_key", "left")
    return found.select(*names.columns, F.coalesce("_owner", "_named").alias("watched_id"))
