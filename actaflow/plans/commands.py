"""Whole commands: from landed files and a watchlist to tables, as lazy DataFrames.

``rebuild`` recomputes everything from the landed documents, whatever their order; an
incremental run gives it the new documents and merges with ``upsert_notices`` and
``insert_absent``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actaflow.functions import catalogue as C
from actaflow.functions.text import name_key
from actaflow.operators import corpus, discovery, facts, graph, matching, measure, officers, positions, process, record, timeline
from actaflow.operators.acts import explode_acts
from actaflow.operators.tables import cut_lineage, numbered


def rebuild(announcements: DataFrame, watched: DataFrame, sheets: DataFrame, tokens: DataFrame | None = None, noise: DataFrame | None = None, pairs: DataFrame | None = None, leads: DataFrame | None = None, guard_days: int = C.GUARD_DAYS, cutoff: float = C.FUZZY_CUTOFF) -> dict[str, DataFrame]:
    """notices, acts, sheets, aliases, values, events, positions, record, leads, tallies.

    ``announcements``: doc_id, num, section, province, day, firm, acts, sheet,
    inscription_date; ``watched``: company_id, group_id, name_key, name, incorporated,
    address, city; ``noise``: (label, n) of crowded addresses; ``pairs``: (pair, group_id)
    of officers' surnames; ``leads``: open leads of earlier runs (lead_id, province, sheet,
    state, found_by).  The sheet of a lead found by mention is followed, whether the
    mention comes before or after the announcement on it."""
    spark = announcements.sparkSession
    a = announcements.withColumn("firm_key", name_key(F.col("firm"))).withColumn("fact_day", F.coalesce("inscription_date", "day"))
    a = cut_lineage(a.withColumn("ends_sheet", F.exists("acts", lambda x: x["act_type"].isin(*C.SHEET_ENDING_ACTS))))
    acts = cut_lineage(explode_acts(a))
    renames = acts.filter("act_type = 'name_change' and detail <> ''").select("doc_id", "num", name_key(F.col("detail")).alias("new_key"))
    none = spark.createDataFrame([], "name_key string, company_id long")
    known, aliases = matching.learn(a, watched, sheets, none, renames, guard_days)
    matched = cut_lineage(matching.match(a, watched, known, aliases, cutoff, guard_days))
    unwatched = matched.filter("company_id is null").select("doc_id", "num")
    open_acts = acts.join(unwatched, ["doc_id", "num"], "left_semi")
    keys = ("doc_id", "num", "seq", "act_type", "fact_day", "firm_key")
    holders = cut_lineage(officers.holdings(acts.filter(F.col("act_type").isin(*C.EVENT_OF_ACT)), keys))
    signals = {
        "mention": discovery.mentions(open_acts, holders, discovery.mention_keys(watched.select("name", "group_id", F.col("company_id").alias("pos")))),
        "address": discovery.address_signal(discovery.at_watched_sites(discovery.registered_addresses(open_acts), discovery.watched_sites(watched.select(F.col("company_id").alias("pos"), "group_id", F.col("address").alias("street"), "city")), noise)),
    }
    if tokens is not None:
        signals["token"] = discovery.token_signal(matched.filter("company_id is null"), tokens)
    if pairs is not None:
        named = open_acts.groupBy("doc_id", "num").agg(F.concat_ws(" ", F.collect_list("detail")).alias("text"))
        signals["person"] = discovery.person_signal(named, pairs, discovery.personal_holdings(open_acts))
    found = cut_lineage(discovery.detect(signals))
    lead_columns = "lead_id string, province string, sheet string, state string, found_by string"
    earlier = spark.createDataFrame([], lead_columns) if leads is None else leads.select(F.col("lead_id").cast("string").alias("lead_id"), "province", "sheet", "state", "found_by")
    first = process.cascade(matched, process.followed_sheets(earlier), found)
    opened = first.filter("kept_as = 'candidate' and signal is not null")
    mentioned = opened.filter("signal = 'mention'").select(F.concat_ws("|", "firm_key", "province").alias("lead_id"), "province", "sheet", F.lit("open").alias("state"), F.col("signal").alias("found_by"))
    kept = cut_lineage(process.cascade(matched, process.followed_sheets(cut_lineage(earlier.unionByName(mentioned))), found))
    found_leads = opened.select("firm_key", "province", "firm", "fact_day", "doc_id", "num", F.col("lead_group").alias("group_id"), F.col("signal").alias("reason"), "evidence")
    empty = spark.createDataFrame([], "firm_key string, province string, group_id long, reason string, evidence string, firm string, first_day date, last_day date, state string")
    links = kept.filter("company_id is not null")
    values, events = process.derive_values(acts, links), process.derive_events(holders, links)
    role_events = events.select("company_id", F.col("fact_day").alias("day"), F.struct("doc_id", "num", "seq", "pos").alias("event_id"), "holder", "role", "label", "kind")
    return {
        "notices": kept.filter("kept_as <> 'discard'"), "acts": acts, "holdings": holders, "sheets": known, "aliases": aliases, "values": values, "events": events,
        "positions": positions.positions_held(role_events), "record": record.record_now(values, links.select("company_id", "fact_day")),
        "leads": discovery.upsert_leads(empty, found_leads), "tallies": process.tallies(kept), "relations": facts.relations(acts, a, holders),
    }


def rebuild_history(acts: DataFrame, notices: DataFrame, listed: DataFrame | None = None) -> dict[str, DataFrame]:
    """values, events, positions and record once more from kept acts, without the documents.

    ``notices``: doc_id, num, company_id, fact_day; ``acts`` as of ``explode_acts``, also of
    announcements that have no company; ``listed``: the watchlist's own values."""
    links = notices.filter("company_id is not null").select("doc_id", "num", "company_id", "fact_day")
    linked = cut_lineage(acts.join(links.select("doc_id", "num"), ["doc_id", "num"], "left_semi"))
    holders = officers.holdings(linked.filter(F.col("act_type").isin(*C.EVENT_OF_ACT)), ("doc_id", "num", "seq", "act_type", "fact_day", "firm_key"))
    values, events = process.derive_values(linked, links), process.derive_events(holders, links)
    if listed is not None:
        values = values.unionByName(listed.select(*values.columns))
    told = events.select("company_id", F.col("fact_day").alias("day"), F.struct("doc_id", "num", "seq", "pos").alias("event_id"), "holder", "role", "label", "kind")
    return {"values": values, "events": events, "positions": positions.positions_held(told), "record": record.record_now(values, links.select("company_id", "fact_day"))}


def ingest(spark: SparkSession, documents: DataFrame, watched: DataFrame, sheets: DataFrame, log: DataFrame, read: DataFrame, start: str, end: str, again: bool = False, **rules: object) -> dict[str, DataFrame]:
    """A run over the landed documents of a range: days that the ``log`` (day, status,
    n_documents, errors) has as published are left out unless ``again``, and so are documents
    that were ``read`` (doc_id).  A day with a document that can't be used fails as a whole
    and is asked for again next time.  The tables of ``rebuild``, and ``days``, the new log."""
    from actaflow.sources.gazette import day_results, plan_range, read_announcements, record_days

    asked = plan_range(spark, start, end, log, again).filter("asked").select("day")
    at_hand = documents.join(asked, "day", "left_semi").select(*documents.columns)
    files = at_hand.select("day", F.when(F.col("problem").isNull(), "published").otherwise("failed").alias("status"), F.when(F.col("problem").isNotNull(), F.concat_ws(": ", "doc_id", "problem")).alias("error"))
    results = cut_lineage(day_results(files))
    good = at_hand.join(results.filter("status = 'published'"), "day", "left_semi").select(*documents.columns)
    out = rebuild(read_announcements(good if again else process.unread(good, read)), watched, sheets, **rules)
    return out | {"days": record_days(log, results)}


def calibrate(announcements: DataFrame, acts: DataFrame, holdings: DataFrame, watched: DataFrame, sheets: DataFrame, tokens: DataFrame, related: DataFrame, cutoff: float = C.FUZZY_CUTOFF) -> dict[str, DataFrame]:
    """The counts by which thresholds are set, all over one kept scan of the gazettes.

    ``announcements``: doc_id, num, section, province, sheet, firm, firm_key,
    other_companies, day, inscription_date; ``related``: (firm_key) of the groups'
    companies.  ``noise`` and ``addresses`` are what discovery reads to leave crowded
    tokens and addresses out."""
    keyed = announcements.select("doc_id", "num", "firm_key")
    sites = cut_lineage(discovery.registered_sites(acts).join(keyed, ["doc_id", "num"]))
    known = discovery.watched_sites(watched.select(F.col("company_id").alias("pos"), "group_id", F.col("address").alias("street"), "city"))
    at = discovery.at_watched_sites(sites, known).join(keyed, ["doc_id", "num"]).select("label", "firm_key")
    firms = announcements.groupBy("firm_key").agg(F.min("firm").alias("firm"))
    token_noise = cut_lineage(measure.noise(measure.token_hits(firms, tokens), tokens.select(F.col("token").alias("key")), related))
    carried = measure.token_hits(firms, tokens).join(related.select("firm_key").distinct(), "firm_key").groupBy("key").agg(F.count_distinct("firm_key").alias("related"))
    owned = announcements.select("firm_key", "province", "sheet").distinct().join(sheets.select("province", "sheet", F.col("company_id").alias("sheet_owner")), ["province", "sheet"], "left")
    labels, towns = corpus.registered_addresses(sites)
    share, top = corpus.role_coverage(holdings.select("label"))
    return {
        "acts": measure.act_tally(acts), "lag": measure.lag_tally(announcements), "incorporation": corpus.incorporation_lag(acts), "name_lengths": corpus.name_lengths(announcements),
        "noise": token_noise, "noise_histogram": measure.histogram(token_noise.select(F.col("n").alias("value")), "value", (0, 2, 5, 10, 20, 50, 200)), "token_cuts": measure.cumulated_cuts(token_noise, carried),
        "addresses": corpus.address_use(at, known.select(F.col("known.label").alias("label")), related), "registered": labels, "towns": towns,
        "fuzzy": corpus.fuzzy_bands(owned.groupBy("firm_key").agg(F.min("sheet_owner").alias("sheet_owner")), watched.select("name_key", "company_id"), cutoff),
        "role_share": share, "role_labels": top,
    }


def formats(announcements: DataFrame, acts: DataFrame, holdings: DataFrame, least: int = 1000, names: int = 500) -> dict[str, DataFrame]:
    """How the gazette prints things, and the word lists and constants that follow.

    ``announcements``: firm_key, province, raw_text, registry_data; ``least`` and ``names``
    are the support that a word needs."""
    from actaflow.operators.acts import sheet_parts

    parts = announcements.select("firm_key", "province", F.explode(F.array(sheet_parts(F.col("registry_data")))).alias("parts"))
    where = acts.filter(F.col("act_type").isin("address_change", "incorporation")).select(F.explode(facts.observations(F.col("act_type"), F.col("detail"))).alias("o"))
    streets = cut_lineage(where.filter("o.field = 'address'").select(F.col("o.value").alias("street")))
    cities = where.filter("o.field = 'city'").select(F.col("o.value").alias("city"))
    # a generator in the same projection would drop the names of the fields inside the test
    marked = holdings.select(F.col("holder_plain").alias("name"), corpus.carries_form(F.col("holder")).alias("marked"))
    marked = marked.select("name", "marked", F.explode(F.array_distinct(F.split("name", " "))).alias("word")).filter("word <> ''")
    lengths = lambda df, c: df.groupBy(F.char_length(c).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    return {
        "boundaries": corpus.boundaries(announcements.select(F.col("raw_text").alias("body"))), "sheet_verdicts": corpus.sheet_verdicts(parts),
        "holders": corpus.holder_quirks(holdings), "holder_lengths": lengths(holdings, "holder"), "record": corpus.record_quirks(acts), "street_lengths": lengths(streets, "street"),
        "company_words": measure.supported_words(marked, least, 0.8, names).filter(~F.col("word").isin(*C.FORM_WORDS)), "street_filler": corpus.street_words(streets, cities, least),
        "generic_words": corpus.generic_words(streets, least, names), "role_labels": corpus.role_labels(holdings.select("label"), max(1, least // 10)),
    }


def stats(announcements: DataFrame, acts: DataFrame) -> dict[str, DataFrame]:
    """Coverage by document, acts by type and scope (with subtotals), and the lag."""
    by = acts.groupingSets([["act_type", "scope"], ["act_type"], ["scope"], []], "act_type", "scope").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    return {"documents": measure.document_counts(announcements, acts), "acts": by, "lag": measure.lag_tally(announcements)}


def evaluate(flagged: DataFrame, ties: DataFrame, holdings: DataFrame, seeds: DataFrame, people: DataFrame, subjects: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Precision and recall of each signal against the companies that ties or shared officers
    relate to a group."""
    related = graph.closure(graph.directed_edges(ties), seeds, max_depth).select(F.col("node").alias("firm_key"), "group_id")
    shared = graph.shared_members(holdings, people, C.SHARED_OFFICERS_MIN).select("firm_key", "group_id")
    return measure.evaluate(flagged, measure.union_truths(related, shared), subjects)


def joined(members: DataFrame, dated: DataFrame, documents: DataFrame) -> DataFrame:
    """When each member joined its group, from the first day of the gazettes at hand."""
    first = documents.agg(F.min("day")).first()[0]
    return timeline.date_entries(members, dated, F.lit(first))


def run_command(spark: SparkSession, documents: str, watchlist: str) -> dict[str, DataFrame]:
    """``rebuild`` from a folder of landed documents and a watchlist file."""
    from actaflow.sources.gazette import read_announcements, read_documents
    from actaflow.sources.lists import read_watchlist

    entries = read_watchlist(spark, watchlist)
    groups = numbered(entries.select("group").distinct(), [F.col("group")], "group_id")
    listed = cut_lineage(numbered(entries, [F.col("name_key")], "company_id").join(groups, "group"))
    sheets = listed.filter("sheet is not null and province is not null").select("province", "sheet", "company_id")
    return rebuild(read_announcements(read_documents(spark, documents)), listed, sheets)
