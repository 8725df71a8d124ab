"""Counts over the whole corpus by which thresholds are set and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actaflow.functions import catalogue as C
from actaflow.functions.text import has_form, name_key, plain, possible_pairs, role_of, split_form, usable_words, words
from actaflow.operators.matching import similar_names
from actaflow.operators.measure import band
from actaflow.operators.tables import first_by, ranked, running


def registered_addresses(sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Companies at each label, and in each municipality, from (firm_key, site)."""
    s = sites.select("firm_key", F.col("site.label").alias("label"), F.col("site.town").alias("town")).distinct()
    by_label = s.groupBy("label").agg(F.count_distinct("firm_key").alias("companies"))
    return by_label, s.groupBy("town").agg(F.count_distinct("firm_key").alias("companies"))


def group_addresses(sites: DataFrame, members: DataFrame, top: int = 3) -> DataFrame:
    """(group_id, label, companies, rank): where most related companies of a group are."""
    s = sites.select("firm_key", F.col("site.label").alias("label")).distinct().join(members.select("firm_key", "group_id"), "firm_key")
    n = s.groupBy("group_id", "label").agg(F.count(F.lit(1)).alias("companies"))
    return ranked(n, ["group_id"], [F.desc("companies"), "label"]).filter(F.col("rank") <= top)


def fuzzy_bands(firms: DataFrame, watched: DataFrame, cutoff: float = C.FUZZY_CUTOFF) -> DataFrame:
    """(band, same_sheet, names): distinct close names in bands of 5 points, by whether the
    sheet says that it is the same company.  ``firms``: (firm_key, sheet_owner); ``watched``:
    (name_key, company_id)."""
    w = watched.withColumn("base", split_form(F.col("name_key"))["base"]).withColumn("pos", F.col("company_id"))
    f = firms.withColumn("base", split_form(F.col("firm_key"))["base"])
    best = similar_names(f.select("base"), w.select("base", "pos"), cutoff)
    near = first_by(w.select(F.col("base").alias("close"), "company_id"), ["close"], ["company_id"])
    j = f.join(best, "base").filter("close <> base").join(near, "close")
    truth = F.when(F.col("sheet_owner").isNull(), "unknown").when(F.col("sheet_owner") == F.col("company_id"), "same").otherwise("other")
    return j.groupBy((F.floor(F.col("score") / 5) * 5).cast("int").alias("band"), truth.alias("truth")).agg(F.count_distinct("firm_key").alias("names"))


def name_lengths(announcements: DataFrame) -> DataFrame:
    """(section, length, n): characters of names in section A, companies listed in B."""
    length = F.when(F.col("section") == "A", F.char_length("firm")).otherwise(1 + F.size("other_companies"))
    return announcements.groupBy("section", length.alias("length")).agg(F.count(F.lit(1)).alias("n"))


def length_quantile(tally: DataFrame, q: float) -> int | None:
    """The value at index int(q (n - 1)) of the values in order, from (length, n)."""
    run = running(tally.select("length", "n"), "length", ["n"], totals=True)
    at = F.floor(F.lit(q) * (F.col("n_all") - 1))
    return run.filter((F.col("n_all") > 0) & (F.col("n_run") > at)).agg(F.min("length")).first()[0]


def role_coverage(labels: DataFrame, top: int = 60) -> tuple[DataFrame, DataFrame]:
    """(known, total), and the most used labels with their roles, from (label)."""
    n = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("role", role_of(F.col("label")))
    return n.agg(F.coalesce(F.sum(F.when(F.col("role") != "other", F.col("n"))), F.lit(0)).alias("known"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")), n.orderBy(F.desc("n"), "label").limit(top)


def incorporation_lag(acts: DataFrame) -> DataFrame:
    """(days, n): from the declared start of operations to the inscription."""
    pattern = r"(?iu)Comienzo\s+de\s+operaciones\s*:\s*(\d{1,2})\s*\.\s*(\d{1,2})\s*\.\s*(\d{2})(?!\d)"
    part = lambda i: F.regexp_extract("detail", pattern, i)
    start = F.try_to_date(F.concat(F.lit("20"), part(3), F.lit("-"), F.lpad(part(2), 2, "0"), F.lit("-"), F.lpad(part(1), 2, "0")), "yyyy-MM-dd")
    a = acts.filter("act_type = 'incorporation' and inscription_date is not null").select(F.datediff("inscription_date", start).alias("days"))
    return a.filter("days is not null").groupBy("days").agg(F.count(F.lit(1)).alias("n"))


def sheet_stability(rows: DataFrame) -> DataFrame:
    """One row of counts over section A announcements (province, sheet, ord, firm_key,
    types) in reading order: what comes on a sheet after its name changed, after it was
    struck off or dissolved, and names that differ without a rename."""
    sheeted = rows.filter("sheet is not null")
    before = Window.partitionBy("province", "sheet").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    had = lambda t: F.coalesce(F.max(F.array_contains("types", t)).over(before), F.lit(False))
    r = sheeted.select("*", had("name_change").alias("renamed"), had("extinction").alias("extinct"), had("dissolution").alias("dissolved"), F.first("firm_key").over(before).alias("first_key"))
    other = F.coalesce(F.col("first_key") != F.col("firm_key"), F.lit(False))
    now = lambda t, c: F.count_if(F.array_contains("types", t) & ~F.col(c))
    return r.agg(
        F.count(F.lit(1)).alias("with_sheet"), F.count_if(F.col("renamed")).alias("after_rename"), F.count_if(F.col("renamed") & other).alias("after_rename_other_name"),
        F.count_if(F.col("extinct")).alias("after_extinction"), F.count_if(F.col("dissolved")).alias("after_dissolution"), F.count_if(~F.col("renamed") & other).alias("name_differs_without_rename"),
        now("name_change", "renamed").alias("renamed_sheets"), now("extinction", "extinct").alias("extinct_sheets"), now("dissolution", "dissolved").alias("dissolved_sheets"),
        F.count_if(F.col("first_key").isNull()).alias("distinct_sheets"),
    )


def signal_hits(signals: dict[str, DataFrame], firms: DataFrame) -> DataFrame:
    """(reason, firm_key, group_id): the first group that each signal, and the detector (the
    most reliable signal of an announcement), gives each firm.  ``firms``: (doc_id, num,
    firm_key, ord)."""
    from actaflow.operators.discovery import detect

    every = None
    for name, rows in [*signals.items(), ("detector", detect(signals))]:
        r = rows.select("doc_id", "num", "group_id", F.lit(name).alias("reason")).join(firms, ["doc_id", "num"])
        every = r if every is None else every.unionByName(r)
    return every.groupBy("reason", "firm_key").agg(F.min_by("group_id", "ord").alias("group_id"))


def pair_counts(texts: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, n) announcements with each word of the names, and (pair, n) companies with
    both words of each pair; ``texts``: (doc_id, num, firm_key, text)."""
    asked = names.select(F.explode(usable_words(F.col("name"))).alias("word")).distinct()
    t = texts.select("doc_id", "num", "firm_key", F.array_distinct(usable_words(F.col("text"))).alias("w"))
    by_word = t.select(F.explode("w").alias("word")).join(asked, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    pairs = names.select(F.explode(possible_pairs(F.col("name"))).alias("pair")).distinct()
    pairs = pairs.withColumns({"a": F.substring_index("pair", " ", 1), "b": F.substring_index("pair", " ", -1)})
    hits = t.select("firm_key", "w", F.explode("w").alias("a")).join(pairs, "a").filter(F.array_contains("w", F.col("b"))).select("pair", "firm_key").distinct()
    return by_word, hits.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def window_checks(dated: DataFrame) -> DataFrame:
    """(what, band, n): days from the incorporation to the group's first sign, and from that
    to the nearest outsider leaving; heads left out.  ``dated``: is_head, founded, sign_day,
    handover."""
    d = dated.filter("not is_head and sign_day is not null")
    a = d.filter("founded is not null").select(F.lit("founded_to_sign").alias("what"), band(F.datediff("sign_day", "founded"), (0, 31, 91, 181, 366, 731, 1826)).alias("band"))
    b = d.filter("handover is not null").select(F.lit("sign_to_handover").alias("what"), band(F.col("handover"), (0, 8, 31, 91, 366)).alias("band"))
    return a.unionByName(b).groupBy("what", "band").agg(F.count(F.lit(1)).alias("n"))


def officers_against_owner(dated: DataFrame) -> DataFrame:
    """(rule, verdict, n, days): for entries that an owner act confirms, the year that the
    officers alone give, and the days between (an array, in order).  ``dated``: rule,
    entry_day, confirmed, officers_day, officers_evidence."""
    d = dated.filter(F.col("confirmed") & F.col("rule").isin("acquired", "founded"))
    none = F.col("officers_day").isNull() | F.col("officers_evidence").isNull()
    year = F.year("officers_day") - F.year("entry_day")
    verdict = F.when(none, "officers give no year").when(year == 0, "officers, same year").when(year > 0, "officers, later year").otherwise("officers, earlier year")
    return d.groupBy("rule", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(~none, F.datediff("officers_day", "entry_day")))).alias("days"))


def boundaries(bodies: DataFrame) -> DataFrame:
    """Counts of headings glued to a capital or after a spaced dash, over (body)."""
    from actaflow.operators.acts import ANY_HEADING, without_accents

    flat = bodies.select(F.explode(F.array(without_accents(F.col("body")))).alias("body"))
    glued = F.regexp_count("body", F.lit(rf"(?<=\p{{Lu}}){ANY_HEADING}"))
    dash = F.regexp_count("body", F.lit(rf"(?<=\.\s{{0,20}}-\s{{0,20}}){ANY_HEADING}"))
    b = flat.select(glued.alias("g"), dash.alias("d"))
    return b.agg(F.count(F.lit(1)).alias("announcements"), F.sum("g").alias("glued_to_capital"), F.sum("d").alias("after_dot_space_dash"), F.count_if((F.col("g") > 0) | (F.col("d") > 0)).alias("announcements_affected"))


def sheet_verdicts(sheets: DataFrame) -> DataFrame:
    """(kind, verdict, n): of announcements with two sheet numbers, which one their company
    prints alone elsewhere.  ``sheets``: (firm_key, province, parts struct of letters,
    number and second)."""
    trim = lambda c: F.regexp_replace(c, r"^0+(?=\d)", "")
    s = sheets.filter("parts is not null").select("firm_key", "province", F.concat_ws(" ", "parts.letters", trim(F.col("parts.number"))).alias("a"), F.when(F.col("parts.second").isNotNull(), F.concat_ws(" ", "parts.letters", trim(F.col("parts.second")))).alias("b"), F.char_length("parts.second").alias("digits"))
    alone = s.filter("b is null").groupBy("firm_key", "province").agg(F.collect_set("a").alias("seen"))
    c = s.filter("b is not null").join(alone, ["firm_key", "province"], "left")
    kind = F.when(F.col("a") == F.col("b"), "repeats the first").otherwise(F.concat(F.least("digits", F.lit(6)).cast("string"), F.lit(" digits"), F.when(F.col("digits") >= 6, "+").otherwise("")))
    in_a, in_b = F.array_contains("seen", F.col("a")), F.array_contains("seen", F.col("b"))
    verdict = F.when(F.col("seen").isNull(), "no other announcement").when(in_a & ~in_b, "first").when(in_b & ~in_a, "second").when(in_a, "both").otherwise("neither")
    return c.groupBy(kind.alias("kind"), verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def carries_form(holder: Column) -> Column:
    """A form at the end, or a form's abbreviation anywhere."""
    tokens = F.array(*map(F.lit, sorted({"SA", "SAL", "SAD", "SL", "SLL", "SLP", "SLNE", "COOP", "AIE", *C.FORMS_AT_END, *C.FORMS_ANYWHERE})))
    return has_form(holder) | F.arrays_overlap(words(name_key(holder)), tokens)


def street_words(streets: DataFrame, cities: DataFrame, least: int = 1000, share: float = 0.5, city_min: int = 100) -> DataFrame:
    """Words that open a street or come after its number in ``share`` of their streets and
    are not a municipality's, from (street) and (city)."""
    t = F.regexp_extract_all(F.upper("street"), F.lit(r"(\d+|[A-Z]+)"), 1)
    s = streets.select(F.explode(F.array(t)).alias("t")).select("t", F.array_position(F.transform("t", lambda x: x.rlike(r"^\d")), True).alias("at"))
    w = s.select("at", F.posexplode("t").alias("i", "word")).filter("length(word) >= 3 and not word rlike '^[0-9]'")
    per = w.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("i") == 0).alias("opening"), F.count_if((F.col("at") > 0) & (F.col("i") >= F.col("at"))).alias("after"))
    town = cities.select(F.explode(words(F.upper("city"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("towns")).filter(F.col("towns") >= city_min)
    return per.filter((F.col("n") >= least) & (F.greatest("opening", "after") >= F.col("n") * share)).join(town, "word", "left_anti")


def samples(rows: DataFrame, bucket: str, order: list, most: int = 25) -> DataFrame:
    """The first rows of each bucket."""
    return ranked(rows, [bucket], order).filter(F.col("rank") <= most).drop("rank")


def address_use(hits: DataFrame, known: DataFrame, related: DataFrame, noise_max: int = C.ADDRESS_NOISE_MAX) -> DataFrame:
    """(label, unrelated, related, used): companies registered at each watched address, and
    whether discovery uses it: not from ``noise_max`` unrelated ones on.  ``hits``: (label,
    firm_key); ``known``: (label); ``related``: (firm_key)."""
    tied = related.select("firm_key", F.lit(True).alias("_tied")).distinct()
    n = hits.select("label", "firm_key").distinct().join(tied, "firm_key", "left").groupBy("label").agg(F.count_if(F.col("_tied").isNull()).alias("unrelated"), F.count("_tied").alias("related"))
    j = known.select("label").distinct().join(n, "label", "left")
    return j.select("label", F.coalesce("unrelated", F.lit(0)).alias("unrelated"), F.coalesce("related", F.lit(0)).alias("related"), (F.coalesce("unrelated", F.lit(0)) < noise_max).alias("used"))


def was_company(holder: Column, vocabulary: tuple[str, ...]) -> Column:
    """A simpler rule, to count what the one in use changes: a form at the end, or one of
    ``vocabulary`` among the words."""
    known = F.array(*map(F.lit, vocabulary)).cast("array<string>")
    return has_form(holder) | F.arrays_overlap(words(plain(holder)), known)


def holder_quirks(holdings: DataFrame, vocabulary: tuple[str, ...] = C.LEGAL_PERSON_WORDS, cut: int = C.HOLDER_CUT) -> DataFrame:
    """One row of counts over (holder, holder_plain, label, is_company)."""
    before = was_company(F.col("holder"), vocabulary)
    return holdings.agg(
        F.count(F.lit(1)).alias("holders"), F.count_distinct("holder_plain").alias("names"), F.count_if(F.col("is_company")).alias("companies"),
        F.count_if(F.col("is_company") & ~before).alias("companies_now_only"), F.count_if(~F.col("is_company") & before).alias("companies_before_only"),
        F.count_if(F.char_length("holder") >= cut).alias("at_the_cut"), F.count_if(F.col("holder").rlike(r"(?<!\p{L})\p{Ll}{3,}(?!\p{L})")).alias("with_lower_case"),
        F.count_if(F.col("holder").rlike(r"\d")).alias("with_digits"), F.count_if(F.char_length("label") >= C.LABEL_MAX).alias("long_labels"),
    )


def record_quirks(acts: DataFrame) -> DataFrame:
    """(act_type, acts, streets, without_city, renamed): what acts that state an address
    give; renamed are those of a street that the council renamed."""
    from actaflow.functions.streets import renamed_street
    from actaflow.operators.facts import observations

    of = F.struct(observations(F.col("act_type"), F.col("detail")).alias("o"), renamed_street(F.col("detail")).alias("renamed"))
    a = acts.filter(F.col("act_type").isin("address_change", "incorporation", "other")).select("act_type", F.explode(F.array(of)).alias("r"))
    states = lambda f: F.exists("r.o", lambda x: x["field"] == f)
    return a.groupBy("act_type").agg(
        F.count(F.lit(1)).alias("acts"), F.count_if(states("address")).alias("streets"), F.count_if(states("address") & ~states("city")).alias("without_city"),
        F.count_if(F.col("r.renamed").isNotNull()).alias("renamed"),
    )


def generic_words(streets: DataFrame, least: int = 1000, names: int = 500) -> DataFrame:
    """Words of three letters or more in ``least`` or more streets and ``names`` or more different street names (the
    letters before the number) that are no street type or entrance word, from (street)."""
    from actaflow.functions.lists import STREET_FILLER

    name = F.trim(F.regexp_extract(plain(F.col("street")), r"^([^\d]*)", 1))
    s = streets.select(F.explode(F.array(name)).alias("name")).select("name", F.explode(F.array_distinct(words(F.col("name")))).alias("word"))
    per = s.groupBy("word", "name").agg(F.count(F.lit(1)).alias("n")).groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("names"))
    return per.filter((F.char_length("word") >= 3) & (F.col("n") >= least) & (F.col("names") >= names) & ~F.col("word").isin(*STREET_FILLER, *C.STREET_TYPES_IN_FULL))


def role_labels(labels: DataFrame, least: int = 100) -> DataFrame:
    """(label, role, n): labels by their letters, in use ``least`` times or more, with the
    role read in them, from (label)."""
    letters = F.trim(F.regexp_replace(F.lower("label"), r"[^\p{L}]+", " "))
    return labels.groupBy(letters.alias("letters")).agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("label")).filter(F.col("n") >= least).select(F.col("letters").alias("label"), role_of(F.col("label")).alias("role"), "n")
