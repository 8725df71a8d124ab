"""Registered queries over rendered announcements, and the same facts in SQL.

The SQL never reads the text: it restates each fact from the columns that the text
was rendered from, so that the two sides check each other.
"""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actaflow.functions import catalogue as C
from actaflow.functions.places import differs
from actaflow.functions.text import name_grams, name_key, plain
from actaflow.operators import corpus, discovery, facts, graph, linking, matching, measure, officers, positions, process, record, timeline
from actaflow.operators.acts import computed_once, explode_acts, with_acts, with_body, with_registry
from actaflow.operators.tables import cut_lineage, shared_folder
from actaflow.plans import commands, synth
from actaflow.sources.gazette import day_results, parse_documents, read_announcements, read_documents
from actaflow.sources.landing import land
from actaflow.streaming import ingest
from actaflow.streaming import positions as seats


def _text(day: str | Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


class Gazette:
    """The rendered announcements of one folder, read once into acts."""

    def __init__(self, spark: SparkSession, sf_dir: str, keep: bool = False, texts: bool = True, registry: bool = True):
        """``keep``: written once to the shared folder, for queries that read them repeatedly,
        and without ``texts`` without those that everything has been read of.  Without ``registry``,
        only the acts and names are read: no sheets, dates and keys of names (see ``keyed``)."""
        self.spark, self.sf_dir = spark, sf_dir
        if not registry:
            read = with_body(synth.announcements(spark, sf_dir).select("doc_id", "num", "firm", "raw_text"))
            self.full = self.announcements = cut_lineage(with_acts(read).select("doc_id", "num", "firm", "acts"))
            return
        read = with_registry(synth.announcements(spark, sf_dir))
        read = computed_once(read, "firm_key", name_key(F.col("firm"))).withColumn("fact_day", F.coalesce("inscription_date", "day"))
        full = with_acts(read) if texts else with_acts(read).drop("raw_text", "registry_data")
        self.full = cut_lineage(full) if keep else full
        # without the acts, which only queries that ask for them pay for
        self.announcements = self.full if keep else read

    @property
    def acts(self) -> DataFrame:
        return explode_acts(self.full)

    def keyed(self) -> DataFrame:
        """(doc_id, num, firm_key), kept; a name's key is made once, however many announcements print it."""
        names = self.full.select("firm").distinct().select(F.col("firm").alias("_name"), name_key(F.col("firm")).alias("firm_key"))
        return cut_lineage(self.full.join(names, F.col("firm").eqNullSafe(F.col("_name"))).select("doc_id", "num", "firm_key"))

    @property
    def raw_acts(self) -> DataFrame:
        """Acts without officer slots: no Python runs."""
        a = self.full.select("*", F.posexplode("acts").alias("_at", "_a")).drop("acts")
        return a.withColumns({"seq": (F.col("_at") + 1).cast("int"), "act_type": F.col("_a.act_type"), "detail": F.col("_a.detail")}).drop("_at", "_a")

    def events(self, acts: DataFrame | None = None) -> DataFrame:
        acts = self.acts if acts is None else acts
        kind = F.lit(None).cast("string")
        for act, event in C.EVENT_OF_ACT.items():
            kind = F.when(F.col("act_type") == act, F.lit(event)).otherwise(kind)
        keys = ("doc_id", "num", "seq", "firm_key", "act_type", "fact_day")
        h = officers.holdings(acts.filter(F.col("act_type").isin(*C.EVENT_OF_ACT)), keys)
        return h.withColumn("kind", kind).withColumn("company_id", F.regexp_extract("firm_key", "([0-9]+)", 1).cast("long"))

    def matched(self) -> DataFrame:
        return matching.exact_match(self.announcements, synth.watched(self.spark, self.sf_dir), synth.sheets(self.spark, self.sf_dir))

    def values(self) -> DataFrame:
        """Dated values of the record: of the registry for watched firms, of the watchlist."""
        w = synth.watched(self.spark, self.sf_dir)
        a = self.raw_acts.join(w.select("company_id", F.col("name_key").alias("firm_key")), "firm_key")
        seen = a.select("company_id", F.lit("registry").alias("source"), "doc_id", "num", F.col("fact_day").alias("day"), F.explode(F.array(facts.observations(F.col("act_type"), F.col("detail")))).alias("_o"))
        seen = seen.select("*", F.explode("_o").alias("o")).select("company_id", "source", "doc_id", "num", "day", "o.field", "o.value").distinct()
        listed = record.held_values(w).filter("held is not null").select("company_id", F.lit("watchlist").alias("source"), F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("long").alias("num"), F.to_date(F.lit("2024-01-01")).alias("day"), "field", F.col("held").alias("value"))
        return seen.unionByName(listed)

    def notices(self) -> DataFrame:
        w = synth.watched(self.spark, self.sf_dir).select("company_id", F.col("name_key").alias("firm_key"))
        return self.announcements.join(w, "firm_key").select("company_id", "doc_id", "num", "fact_day")

    def relations(self) -> DataFrame:
        return facts.relations(self.raw_acts)


def q_acts_by_type(spark, sf_dir):
    return measure.act_tally(Gazette(spark, sf_dir).acts)


def q_inscription_lag(spark, sf_dir):
    return measure.lag_tally(Gazette(spark, sf_dir).announcements)


def q_lag_quantiles(spark, sf_dir):
    tally = measure.lag_tally(Gazette(spark, sf_dir).announcements)
    out = None
    for q in (0.1, 0.5, 0.9):
        row = measure.discrete_quantile(tally, "days", "n", q).select(F.lit(q).alias("q"), F.col("value").alias("days"))
        out = row if out is None else out.unionByName(row)
    return out


def q_sheet_parts(spark, sf_dir):
    return Gazette(spark, sf_dir).announcements.select("doc_id", "num", "sheet", _text("inscription_date").alias("inscribed"))


def q_name_key(spark, sf_dir):
    return Gazette(spark, sf_dir).announcements.groupBy("firm_key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("firm").alias("spellings"))


def q_amounts(spark, sf_dir):
    a = Gazette(spark, sf_dir).raw_acts.select("num", "act_type", F.explode(F.array(facts.observations(F.col("act_type"), F.col("detail")))).alias("_o"))
    a = a.select("num", "act_type", F.explode("_o").alias("o")).filter("o.field = 'capital'")
    return a.select("num", "act_type", (F.col("o.value").cast("decimal(18,2)") * 100).cast("long").alias("cents"))


def q_observations(spark, sf_dir):
    a = Gazette(spark, sf_dir).raw_acts.select(F.explode(F.array(facts.observations(F.col("act_type"), F.col("detail")))).alias("_o")).select(F.explode("_o").alias("o"))
    return a.filter("o.field <> 'capital'").groupBy("o.field", "o.value").agg(F.count(F.lit(1)).alias("n"))


def q_holders(spark, sf_dir):
    e = Gazette(spark, sf_dir).events()
    return e.select("num", "role", "label", "holder", "is_company", "kind")


def q_priorities(spark, sf_dir):
    return Gazette(spark, sf_dir).acts.groupBy("act_type", "priority").agg(F.count(F.lit(1)).alias("n"))


def q_document_counts(spark, sf_dir):
    g = Gazette(spark, sf_dir, keep=True, texts=False)
    return measure.document_counts(g.full, g.raw_acts)


def q_exact_match(spark, sf_dir):
    return Gazette(spark, sf_dir).matched().filter("company_id is not null or suggestion is not null").select("num", "company_id", "via", "suggestion", "score")


def q_fixpoint_links(spark, sf_dir):
    g = Gazette(spark, sf_dir)
    ends = F.exists("acts", lambda a: a["act_type"].isin(*C.SHEET_ENDING_ACTS))
    a = cut_lineage(g.full.withColumn("ends_sheet", ends).select("doc_id", "num", "province", "sheet", "firm_key", "fact_day", "ends_sheet"))
    none = spark.createDataFrame([], "name_key string, company_id long")
    renames = spark.createDataFrame([], "doc_id string, num long, new_key string")
    known, _ = matching.learn(a, synth.watched(spark, sf_dir), synth.sheets(spark, sf_dir), none, renames)
    return known


def _link_facts(spark, sf_dir) -> DataFrame:
    """Facts of the announcements with renames, all read from their texts."""
    read = with_registry(synth.announcements(spark, sf_dir, renames=True))
    read = computed_once(read, "firm_key", name_key(F.col("firm"))).withColumn("fact_day", F.coalesce("inscription_date", "day"))
    a = with_acts(read).withColumn("ends_sheet", F.exists("acts", lambda a: a["act_type"].isin(*C.SHEET_ENDING_ACTS)))
    names = F.transform(F.filter("acts", lambda a: (a["act_type"] == "name_change") & (a["detail"] != "")), lambda a: a["detail"])
    a = cut_lineage(a.select("doc_id", "num", "province", "sheet", "firm_key", "fact_day", "ends_sheet", names.alias("names")))
    renames = a.select("doc_id", "num", F.explode("names").alias("name")).select("doc_id", "num", name_key(F.col("name")).alias("new_key"))
    return cut_lineage(linking.facts_of(a, renames))


def _link_base(spark, sf_dir) -> linking.Base:
    watched = synth.watched(spark, sf_dir).select("company_id", "name_key", "incorporated")
    return linking.Base(cut_lineage(watched), cut_lineage(synth.sheets(spark, sf_dir)), spark.createDataFrame([], "name_key string, company_id long"))


def q_incremental_links(spark, sf_dir):
    """Documents come latest first, a part of them wrong at first and some that are
    withdrawn again; what has been learned in the end, and the links that follow from it."""
    facts, base = _link_facts(spark, sf_dir), _link_base(spark, sf_dir)
    first, last = facts.agg(F.min("fact_day"), F.max("fact_day")).first()
    middle = first + (last - first) / 2
    late, early = facts.filter(F.col("fact_day") > F.lit(middle)), facts.filter(F.col("fact_day") <= F.lit(middle))
    # doc_ids name a day, so both halves hold whole documents but for inscriptions over the border
    split = cut_lineage(early.select("doc_id").distinct())
    late = late.join(split, "doc_id", "left_anti").select(*facts.columns)
    early = facts.join(split, "doc_id", "left_semi").select(*facts.columns)
    wrong = late.withColumns({"sheet": F.concat(F.lit("M 9"), F.substring_index("sheet", " ", -1)), "new_keys": F.transform("new_keys", lambda x: F.concat(x, F.lit(" EN ERROR")))})
    extra = early.withColumns({"doc_id": F.concat(F.lit("EXTRA-"), F.col("doc_id")), "new_keys": F.array(F.concat(F.lit("OTRA "), F.col("firm_key"))), "sheet": F.concat(F.lit("X "), F.col("num").cast("string"))})
    state = linking.link_all(wrong.unionByName(extra), base)
    state = linking.apply_changes(state, base, late.unionByName(early), extra.select("doc_id").distinct())
    rows = state.sheets.select(F.lit("sheet").alias("kind"), F.concat_ws("|", "province", "sheet").alias("key"), "company_id")
    rows = rows.unionByName(state.aliases.select(F.lit("alias").alias("kind"), F.col("name_key").alias("key"), "company_id"))
    linked = state.links.filter("company_id is not null").groupBy("via", "company_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("n", F.lit(1).cast("long")).unionByName(linked.select(F.lit("links").alias("kind"), F.col("via").alias("key"), "company_id", "n"))


def q_blocked_site(spark, sf_dir):
    g = Gazette(spark, sf_dir)
    seen = discovery.registered_addresses(g.raw_acts)
    w = synth.watched(spark, sf_dir).select(F.col("company_id").alias("pos"), "group_id", F.col("address").alias("street"), "city")
    return discovery.at_watched_sites(seen, discovery.watched_sites(w)).select("num", "group_id", "label")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = synth.watched(spark, sf_dir)
    return w.select(F.concat(F.lit("EMPRESA "), F.col("company_id").cast("string")).alias("token"), "group_id")


def q_token_signal(spark, sf_dir):
    return discovery.token_signal(Gazette(spark, sf_dir).announcements, _tokens(spark, sf_dir)).select("num", "group_id", "evidence")


def q_mentions(spark, sf_dir):
    w = synth.watched(spark, sf_dir)
    keys = discovery.mention_keys(w.select("name", "group_id", F.col("company_id").alias("pos")))
    acts = Gazette(spark, sf_dir).raw_acts
    return discovery.mentions(acts, None, keys).select("num", "group_id", "evidence")


def q_relations(spark, sf_dir):
    return Gazette(spark, sf_dir).relations().groupBy("firm_key", "kind", "other_key").agg(F.count(F.lit(1)).alias("n"))


def q_closure(spark, sf_dir):
    """From all watched companies, and from the lower half of them: an owner's number is seven
    times its company's, so that half reaches into the upper one."""
    edges = cut_lineage(graph.directed_edges(Gazette(spark, sf_dir).relations()))
    every = synth.watched(spark, sf_dir)
    out = None
    for name, part in (("all", every), ("lower", every.filter(F.col("company_id") * 2 < synth.n_users(spark, sf_dir)))):
        rows = graph.closure(edges, part.select(F.col("name_key").alias("node"), "group_id")).withColumn("seeds", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def q_record_now(spark, sf_dir):
    g = Gazette(spark, sf_dir, keep=True, texts=False)
    now = record.record_now(g.values(), g.notices())
    return now.select("company_id", "field", "source", "value", _text("day").alias("day"))


def q_outlived(spark, sf_dir):
    g = Gazette(spark, sf_dir, keep=True, texts=False)
    return record.outlived(g.values(), g.notices()).select("company_id", "value", _text("day").alias("day"), "num")


def q_proposals(spark, sf_dir):
    g = Gazette(spark, sf_dir, keep=True, texts=False)
    log = spark.sql("SELECT 1L AS entry_id, 0L AS company_id, 'purpose' AS field, CAST(NULL AS STRING) AS replaced, 'X' AS written, 'applied' AS state, DATE'2024-01-01' AS fact_day, 'D' AS doc_id, 1L AS num")
    now = record.record_now(g.values(), g.notices())
    return record.proposals(synth.watched(spark, sf_dir), now, log).select("why", "company_id", "field", "held", "proposed")


def q_positions(spark, sf_dir):
    e = Gazette(spark, sf_dir).events().select("company_id", F.col("fact_day").alias("day"), F.col("num").alias("event_id"), "holder", "role", "label", "kind")
    return positions.positions_held(e).select("company_id", "event_id", "role", "holder")


def q_stream_positions(spark, sf_dir):
    """Positions held after a stream of all officer events, which come in files of no order
    and are written in batches that a rerun doesn't double."""
    folder = shared_folder(spark, "stream")
    e = Gazette(spark, sf_dir).events().select("company_id", F.col("fact_day").alias("day"), F.col("num").alias("event_id"), "holder", "role", "label", "kind")
    e.repartition(3, F.xxhash64("event_id")).write.parquet(f"{folder}/events")
    before = spark.conf.get(seats.ROCKSDB[0])
    spark.conf.set(*seats.ROCKSDB)
    try:
        stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/events")
        ingest.run_available(seats.position_changes(stream), f"{folder}/changes", "update")
    finally:
        spark.conf.set(seats.ROCKSDB[0], before)
    held = seats.held_now(ingest.read_batches(spark, f"{folder}/changes", seats.CHANGE))
    return held.select("company_id", "event_id", "role", "holder")


def q_powers_spread(spark, sf_dir):
    e = Gazette(spark, sf_dir).events().select("company_id", F.col("fact_day").alias("day"), "holder", "kind")
    members = synth.users(spark, sf_dir).select(F.col("id").alias("company_id"), (F.col("id") % 3).alias("group_id"))
    return positions.powers_spread(e, members).select("group_id", "holder_plain", _text("day").alias("day"), "kind", "companies")


def q_shared_members(spark, sf_dir):
    e = Gazette(spark, sf_dir).events()
    watched = synth.watched(spark, sf_dir).select("company_id")
    group = e.join(watched, "company_id", "left_semi").select("holder_plain", (F.col("company_id") % 3).alias("group_id")).distinct()
    return graph.shared_members(e, group, 3)


def q_sheet_stability(spark, sf_dir):
    a = Gazette(spark, sf_dir).full
    return corpus.sheet_stability(a.select("province", "sheet", F.col("num").alias("ord"), "firm_key", F.transform("acts", lambda x: x["act_type"]).alias("types")))


def q_cascade(spark, sf_dir):
    g = Gazette(spark, sf_dir, keep=True, texts=False)
    leads = spark.sql("SELECT 1L AS lead_id, 'PROVINCE 1' AS province, 'M 11' AS sheet, 'open' AS state, 'mention' AS found_by UNION ALL SELECT 2L, 'PROVINCE 2', 'M 12', 'gone', 'mention'")
    matched = matching.exact_match(g.announcements, synth.watched(spark, sf_dir), synth.sheets(spark, sf_dir))
    return process.tallies(process.cascade(matched, process.followed_sheets(leads), discovery.detect(_signals(g))))


def q_name_lengths(spark, sf_dir):
    a = Gazette(spark, sf_dir).announcements.withColumns({"section": F.lit("A"), "other_companies": F.array().cast("array<string>")})
    return corpus.name_lengths(a)


def q_role_coverage(spark, sf_dir):
    return corpus.role_coverage(Gazette(spark, sf_dir).events().select("label"))[1]


def q_incorporation_lag(spark, sf_dir):
    return corpus.incorporation_lag(Gazette(spark, sf_dir).raw_acts)


def q_registered_addresses(spark, sf_dir):
    g = Gazette(spark, sf_dir, keep=True, texts=False)
    sites = discovery.registered_sites(g.raw_acts).join(g.announcements.select("doc_id", "num", "firm_key"), ["doc_id", "num"])
    return corpus.registered_addresses(sites)[0]


def q_pair_counts(spark, sf_dir):
    g = Gazette(spark, sf_dir)
    texts = g.full.select("doc_id", "num", "firm_key", F.array_join(F.transform("acts", lambda x: x["detail"]), " ").alias("text"))
    names = spark.sql("SELECT explode(array('PERSONA ALFA', 'PERSONA BRAVO', 'PERSONA NADIE')) AS name")
    return corpus.pair_counts(texts, names)[1]


def q_signal_hits(spark, sf_dir):
    g = Gazette(spark, sf_dir, keep=True, registry=False)
    hits = corpus.signal_hits(_signals(g), g.keyed().select("*", F.col("num").alias("ord")))
    return hits.groupBy("reason", "group_id").agg(F.count(F.lit(1)).alias("firms"))


def q_lead_aggregates(spark, sf_dir):
    notices = Gazette(spark, sf_dir).announcements.select((F.col("num") % 20).alias("lead_id"), "fact_day")
    leads = spark.range(0, 30).select(F.col("id").alias("lead_id"), F.lit(5).cast("long").alias("notice_count"), F.to_date(F.lit("2023-01-01")).alias("first_day"), F.to_date(F.lit("2023-01-02")).alias("last_day"))
    r = process.refresh_leads(leads, notices)
    return r.select("lead_id", "notice_count", _text("first_day").alias("first_day"), _text("last_day").alias("last_day"))


def q_token_noise(spark, sf_dir):
    firms = Gazette(spark, sf_dir).announcements.select("firm_key", F.concat(F.regexp_extract(name_key(F.col("firm")), "^(.*) SL$", 1)).alias("firm"))
    tokens = spark.range(0, 10).select(F.col("id").cast("string").alias("token")).unionByName(spark.sql("SELECT 'EMPRESA' AS token"))
    related = spark.range(0, 20).select(F.concat(F.lit("EMPRESA "), F.col("id").cast("string"), F.lit(" SL")).alias("firm_key"))
    return measure.noise(measure.token_hits(firms.distinct(), tokens), tokens.select(F.col("token").alias("key")), related)


def q_address_noise(spark, sf_dir):
    g = Gazette(spark, sf_dir, keep=True, texts=False)
    w = synth.watched(spark, sf_dir).select(F.col("company_id").alias("pos"), "group_id", F.col("address").alias("street"), "city")
    sites = discovery.watched_sites(w)
    hits = discovery.at_watched_sites(discovery.registered_addresses(g.raw_acts), sites).join(g.announcements.select("doc_id", "num", "firm_key"), ["doc_id", "num"])
    related = synth.watched(spark, sf_dir).select(F.col("name_key").alias("firm_key"))
    return measure.noise(hits.select(F.col("label").alias("key"), "firm_key"), sites.select(F.col("known.label").alias("key")), related)


def q_collisions(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(plain(F.col("p_name")).alias("name"))
    people = spark.read.parquet(f"{sf_dir}/part.parquet").select(plain(F.split("p_name", " ")[0]).alias("name")).unionByName(names)
    return measure.name_collisions(names, people, 3)


def q_bands(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").join(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), F.col("o_orderkey") == F.col("l_orderkey"))
    days = F.datediff("l_shipdate", "o_orderdate")
    return o.groupBy(measure.band(days, (0, 31, 91, 181, 366, 731, 1826)).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def q_histogram(spark, sf_dir):
    per = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return measure.histogram(per.select(F.col("n").alias("value")), "value", (0, 2, 5, 10, 20, 50, 200))


def _signals(g: Gazette) -> dict[str, DataFrame]:
    w = synth.watched(g.spark, g.sf_dir)
    keys = discovery.mention_keys(w.select("name", "group_id", F.col("company_id").alias("pos")))
    sites = discovery.watched_sites(w.select(F.col("company_id").alias("pos"), "group_id", F.col("address").alias("street"), "city"))
    return {
        "mention": discovery.mentions(g.raw_acts, None, keys),
        "address": discovery.address_signal(discovery.at_watched_sites(discovery.registered_addresses(g.raw_acts), sites)),
        "token": discovery.token_signal(g.announcements, _tokens(g.spark, g.sf_dir)),
    }


def q_detect(spark, sf_dir):
    g = Gazette(spark, sf_dir, keep=True, registry=False)
    return discovery.detect(_signals(g)).select("num", "reason", "group_id")


def q_eval(spark, sf_dir):
    g = Gazette(spark, sf_dir, keep=True, registry=False)
    keyed = g.keyed()
    flagged = None
    for name, rows in _signals(g).items():
        first = rows.join(keyed, ["doc_id", "num"]).groupBy("firm_key").agg(F.min_by("group_id", "num").alias("group_id")).withColumn("reason", F.lit(name))
        flagged = first if flagged is None else flagged.unionByName(first)
    truth = spark.range(0, 60).select(F.concat(F.lit("EMPRESA "), F.col("id").cast("string"), F.lit(" SL")).alias("firm_key"), (F.col("id") % 3).alias("group_id"))
    return measure.evaluate(flagged, truth, keyed.select("firm_key"))


def q_triage(spark, sf_dir):
    g = Gazette(spark, sf_dir, keep=True, texts=False)
    found = discovery.detect(_signals(g)).join(g.announcements.select("doc_id", "num", "firm_key", "province", "firm", "fact_day", "day"), ["doc_id", "num"])
    leads = found.groupBy("firm_key").agg(F.min_by(F.struct("group_id", "reason"), "num").alias("b"), F.count(F.lit(1)).alias("n"), F.max("day").alias("last_day"))
    leads = leads.select(F.regexp_extract("firm_key", "([0-9]+)", 1).cast("long").alias("lead_id"), "b.group_id", F.col("firm_key").alias("firm"), "b.reason", "n", "last_day", F.lit("open").alias("state"))
    precision = {s: 1 / i for i, s in enumerate(C.SIGNALS, 1)} | {"mention": 0.9}
    scored = measure.triage(leads, _tokens(spark, sf_dir), F.to_date(F.lit("2024-03-31")), precision)
    return scored.select("lead_id", "reason", "brand", F.round("score", 3).alias("score"), "tier")


def q_timeline_entry(spark, sf_dir):
    g = Gazette(spark, sf_dir, keep=True, texts=False)
    company = F.regexp_extract("firm_key", "([0-9]+)", 1).cast("long")
    acts = g.raw_acts
    born = acts.filter("act_type = 'incorporation'").select(company.alias("company_id"), F.col("fact_day").alias("day"), "num", F.lit("incorporated").alias("kind"), F.lit(False).alias("by_group"), F.lit("incorporation").alias("note"))
    rel = g.relations().join(g.announcements.select("doc_id", "num", "fact_day"), ["doc_id", "num"])
    owner = F.regexp_extract("other_key", "([0-9]+)", 1).cast("long")
    owned = rel.filter("kind = 'owned_by'").select(company.alias("company_id"), F.col("fact_day").alias("day"), "num", F.lit("owner").alias("kind"), (owner % 3 == F.regexp_extract("firm_key", "([0-9]+)", 1).cast("long") % 3).alias("by_group"), F.col("other").alias("note"))
    e = g.events().filter(F.col("role").isin(*C.CONTROL_ROLES))
    body = e.select("company_id", F.col("fact_day").alias("day"), "num", F.when(F.col("kind").isin(*C.OPENING_EVENTS), "body_in").otherwise("body_out").alias("kind"), F.lit(False).alias("by_group"), F.col("label").alias("note"))
    members = synth.users(spark, sf_dir).select(F.col("id").alias("company_id"), (F.col("id") == 0).alias("is_head"), F.when(F.col("id") % 20 == 0, F.to_date(F.lit("2024-04-20"))).alias("incorporated"))
    every = born.unionByName(owned).unionByName(body).withColumnRenamed("num", "at")
    out = timeline.date_entries(members, every, F.to_date(F.lit("2009-01-02")))
    return out.select("company_id", "rule", _text("entry_day").alias("entry_day"), "evidence", "confirmed", "year")


def q_upsert_notices(spark, sf_dir):
    m = Gazette(spark, sf_dir).matched().withColumn("kept_as", matching.kept_as(F.col("company_id"), F.col("suggestion"), F.lit(None)))
    old = m.filter("num % 3 <> 0").select("doc_id", "num", "company_id", "suggestion", "kept_as")
    new = m.filter("num % 2 = 0 or num % 3 = 0").select("doc_id", "num", F.when(F.col("num") % 4 == 0, F.col("company_id")).alias("company_id"), F.lit(None).cast("long").alias("suggestion"), F.lit("discarded").alias("kept_as"))
    return matching.upsert_notices(old, new).groupBy("kept_as").agg(F.count(F.lit(1)).alias("n"), F.count("company_id").alias("linked"), F.count("suggestion").alias("suggested"))


def q_relink(spark, sf_dir):
    m = Gazette(spark, sf_dir).matched().filter("company_id is null").select("doc_id", "num", "province", "sheet", "company_id")
    u = F.col("id")
    owned = synth.users(spark, sf_dir).filter("id % 7 = 0").select(F.concat(F.lit("PROVINCE "), (u % synth.PROVINCES).cast("string")).alias("province"), F.concat(F.lit("M "), u.cast("string")).alias("sheet"), u.alias("company_id"))
    return matching.relink(m, owned).select("num", "company_id")


def q_prune(spark, sf_dir):
    m = Gazette(spark, sf_dir).matched().select("num", "company_id", "suggestion", (F.col("num") % 50).alias("lead_id"))
    leads = spark.range(0, 50).select(F.col("id").alias("lead_id"), F.when(F.col("id") % 5 == 0, "open").otherwise("gone").alias("state"))
    return matching.prune(m, leads).groupBy("lead_id").agg(F.count(F.lit(1)).alias("n"))


def q_derived_words(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    w = d.select(F.col("source").alias("name"), (F.col("lang") == "en").alias("marked"), F.explode(F.filter(F.split(F.regexp_replace("text", r"[\x09-\x0D]", " "), " "), lambda x: x != "")).alias("word"))
    return measure.supported_words(w, 200, 0.8, 10)


def q_token_cuts(spark, sf_dir):
    noise = q_token_noise(spark, sf_dir)
    kept = noise.select("key", F.char_length("key").alias("related"))
    return measure.cumulated_cuts(noise, kept)


def q_name_grams(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.explode(name_grams(F.col("p_name"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def q_fuzzy_best(spark, sf_dir):
    """Part names with a letter left out, doubled or swapped against all part names."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(plain(F.col("p_name")).alias("name"), "p_partkey")
    n = F.char_length("name")
    typo = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.expr("substring(name, 1, char_length(name) div 2)"), F.expr("substring(name, char_length(name) div 2 + 2)"))).when(F.col("p_partkey") % 3 == 1, F.concat("name", F.expr("right(name, 1)"))).otherwise(F.col("name"))
    bases = p.groupBy("name").agg(F.min("p_partkey").alias("pos")).select(F.col("name").alias("base"), "pos")
    return matching.similar_names(p.select(typo.alias("base")), bases).select("base", "close", F.round("score", 4).alias("score"))


def q_differs(spark, sf_dir):
    """Values of the record in other spellings, field by field."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") % 7).alias("m"))
    n = F.col("event_id").cast("string")
    held = F.when(F.col("m") == 0, F.concat(F.lit("CL MAYOR "), n)).when(F.col("m") == 1, F.concat(F.lit("CL MAYOR "), n)).when(F.col("m") == 2, F.concat(n, F.lit(".50"))).when(F.col("m") == 3, "DONOSTIA").when(F.col("m") == 4, F.concat(F.lit("UNO "), n, F.lit(" SL"))).when(F.col("m") == 5, "active").otherwise("Abc")
    value = F.when(F.col("m") == 0, F.concat(F.lit("Calle Mayor, "), n)).when(F.col("m") == 1, F.concat(F.lit("CL MAYOR 1"), n)).when(F.col("m") == 2, F.concat(n, F.lit(".5"))).when(F.col("m") == 3, "Donostia/San Sebastián").when(F.col("m") == 4, F.concat(F.lit("Uno "), n, F.lit(", Sociedad Limitada"))).when(F.col("m") == 5, "extinct").otherwise("ÁBC")
    field = F.element_at(F.array(*map(F.lit, ("address", "address", "capital", "city", "name", "status", "purpose"))), (F.col("m") + 1).cast("int"))
    rows = e.select("m", field.alias("field"), held.alias("held"), value.alias("value"))
    return rows.groupBy("m", differs(F.col("field"), F.col("held"), F.col("value")).alias("differs")).agg(F.count(F.lit(1)).alias("n"))


#: Announcements of a part of a landed document: the reader takes time with the square of one.
PART = 1000


def q_read_documents(spark, sf_dir):
    """Landed files of section A, written as XML and read back."""
    read = read_announcements(read_documents(spark, f"{synth.landed(spark, sf_dir, ('A',), PART)}/A"))
    return read.groupBy("doc_id", _text("day").alias("day"), "province").agg(F.count(F.lit(1)).alias("announcements"), F.count("sheet").alias("with_sheet"), F.sum(F.size("acts")).alias("acts"))


def q_landing(spark, sf_dir):
    """Days of a range out of a store of landed payloads, two empty days among them, and what
    the payloads hold."""
    first, last = synth.announcements(spark, sf_dir).agg(F.min("day"), F.date_add(F.max("day"), 2)).first()
    rows = cut_lineage(land(spark, synth.fill_store(spark, sf_dir), synth.INDEX, first.isoformat(), last.isoformat(), offline=True, content=True))
    held = read_announcements(parse_documents(rows)).groupBy("day").agg(F.count(F.lit(1)).alias("announcements"))
    days = day_results(rows.select("day", "status", "error")).join(held, "day", "left")
    return days.select(_text("day").alias("day"), "status", "n_documents", F.coalesce("announcements", F.lit(0)).alias("announcements"))


def q_ingest(spark, sf_dir):
    """Landed documents taken in by a stream whose first run is killed after it wrote a batch
    and before it marked it: days and announcements once each."""
    landed, folder = synth.landed(spark, sf_dir, ("A",)), shared_folder(spark, "ingest")

    def killed(batch: DataFrame, number: int) -> None:
        for name, rows in ingest.tables_of_documents(batch).items():
            rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/{name}/{number}")
        raise InterruptedError("killed")

    try:
        ingest.ingest_documents(spark, f"{landed}/A", folder, killed)
    except StreamingQueryException:
        pass
    ingest.ingest_documents(spark, f"{landed}/A", folder)
    ingest.ingest_documents(spark, f"{landed}/A", folder)
    out = ingest.ingested(spark, folder)
    held = out["announcements"].groupBy("day").agg(F.count(F.lit(1)).alias("announcements"), F.count("sheet").alias("with_sheet"))
    return out["days"].join(held, "day", "left").select(_text("day").alias("day"), "status", "n_documents", "announcements", "with_sheet")


def q_section_b(spark, sf_dir):
    """Announcements of section B out of landed files."""
    read = read_announcements(read_documents(spark, f"{synth.landed(spark, sf_dir, ('B',), PART)}/B"))
    act = F.get("acts", F.lit(0))
    return read.select("doc_id", "num", "firm", F.array_join("other_companies", "; ").alias("others"), _text("inscription_date").alias("inscribed"), act["act_type"].alias("act_type"), act["detail"].alias("detail"))


def _rebuilt(spark, sf_dir):
    g = Gazette(spark, sf_dir, keep=True, texts=False)
    a = g.full.withColumn("section", F.lit("A"))
    return g, commands.rebuild(a, synth.watched(spark, sf_dir), synth.sheets(spark, sf_dir), _tokens(spark, sf_dir))


def q_rebuild(spark, sf_dir):
    """Rows of the tables that a rebuild gives, announcements by where they are kept."""
    _, out = _rebuilt(spark, sf_dir)
    rows = out["tallies"].select(F.col("kept_as").alias("part"), "n")
    for name in ("sheets", "values", "events", "leads"):
        rows = rows.unionByName(out[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n"))
    return rows


def q_rebuild_history(spark, sf_dir):
    """The values of the record now, from kept acts alone."""
    g = Gazette(spark, sf_dir, keep=True, texts=False)
    notices = g.matched().select("doc_id", "num", "company_id", "fact_day")
    out = commands.rebuild_history(g.acts, notices)
    return out["record"].select("company_id", "field", "value", _text("day").alias("day"))


def q_watched_lookup(spark, sf_dir):
    g = Gazette(spark, sf_dir)
    found = matching.watched_lookup(g.announcements.select("num", "firm", "province", "sheet"), synth.watched(spark, sf_dir), synth.sheets(spark, sf_dir))
    return found.filter("watched_id is not null").select("num", "watched_id")


def q_address_use(spark, sf_dir):
    g = Gazette(spark, sf_dir, keep=True, texts=False)
    keyed = g.announcements.select("doc_id", "num", "firm_key")
    w = synth.watched(spark, sf_dir)
    sites = discovery.watched_sites(w.select(F.col("company_id").alias("pos"), "group_id", F.col("address").alias("street"), "city"))
    hits = discovery.at_watched_sites(discovery.registered_addresses(g.raw_acts), sites).join(keyed, ["doc_id", "num"])
    return corpus.address_use(hits, sites.select(F.col("known.label").alias("label")), w.select(F.col("name_key").alias("firm_key")))


def q_role_labels(spark, sf_dir):
    return corpus.role_labels(Gazette(spark, sf_dir).events().select("label"), 10)


QUERIES = {name: f for name, f in dict(globals()).items() if name.startswith("q_")}

_EV = """
WITH ev AS (
  SELECT event_id AS num, user_id AS u, event_type AS t, CAST(ts AS DATE) AS day,
    CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, CAST(floor(value * 100 + 1e-6) AS BIGINT) AS cents,
    'GZ-A-' || strftime(ts, '%Y%m%d') || '-' || lpad(CAST(user_id % 5 AS VARCHAR), 2, '0') AS doc_id,
    'PROVINCE ' || (user_id % 5) AS province, 'EMPRESA ' || user_id || ' SL' AS firm_key,
    CASE WHEN event_id % 11 <> 0 THEN 'M ' || user_id END AS sheet,
    CAST(CAST(ts AS DATE) - CAST(event_id % 15 AS INTEGER) AS DATE) AS fact_day
  FROM events
),
lab AS (
  SELECT ev.*, list_element(['Adm. Unico','Consejero','Apoderado','Auditor','Adm. Solid','Secretario'], CAST(k % 6 + 1 AS INTEGER)) AS label,
    list_element(['sole_director','board_member','attorney','auditor','joint_several_director','secretary'], CAST(k % 6 + 1 AS INTEGER)) AS role,
    list_element(['board','board','attorney','auditor','board','board'], CAST(k % 6 + 1 AS INTEGER)) AS officer_scope,
    'PERSONA ' || list_element(['ALFA','BRAVO','CHARLIE','DELTA','ECO','FOXTROT','GOLF','HOTEL','INDIA','JULIETT','KILO','LIMA','MIKE','NOVEMBER','OSCAR','PAPA','QUEBEC','ROMEO','SIERRA','TANGO'], CAST(k % 20 + 1 AS INTEGER)) AS holder
  FROM ev
),
acts AS (
  SELECT num, u, doc_id, firm_key, fact_day, 1 AS at, CASE WHEN num % 13 = 0 THEN 'website' ELSE 'erratum' END AS act_type, 'company' AS scope FROM lab WHERE num % 13 = 0 OR num % 17 = 0
  UNION ALL
  SELECT num, u, doc_id, firm_key, fact_day, 2, CASE t WHEN 'signup' THEN 'incorporation' WHEN 'purchase' THEN 'capital_increase' WHEN 'view' THEN 'appointment' WHEN 'click' THEN 'officer_removal' ELSE 'address_change' END,
    CASE WHEN t IN ('view', 'click') THEN officer_scope ELSE 'company' END FROM lab
  UNION ALL
  SELECT num, u, doc_id, firm_key, fact_day, 3, 'sole_shareholder_declared', 'company' FROM lab WHERE num % 6 = 0
  UNION ALL
  SELECT num, u, doc_id, firm_key, fact_day, 4, CASE WHEN num % 97 = 0 THEN 'extinction' ELSE 'dissolution' END, 'company' FROM lab WHERE num % 97 = 0 OR num % 89 = 0
),
wat AS (SELECT CAST(i AS BIGINT) AS company_id, i % 3 AS group_id, 'EMPRESA ' || i || ' SL' AS name_key, CASE WHEN i % 20 = 0 THEN DATE '2024-04-20' END AS incorporated FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 10 = 0) r(i)),
pos AS (SELECT u AS company_id, fact_day AS day, num AS event_id, holder, role, label, CASE t WHEN 'view' THEN 'appointment' ELSE 'removal' END AS kind FROM lab WHERE t IN ('view', 'click')),
rel AS (SELECT num, u, firm_key, doc_id, fact_day, (u * 7) % (SELECT max(user_id) + 1 FROM events) AS o, 'EMPRESA ' || ((u * 7) % (SELECT max(user_id) + 1 FROM events)) || ' SL' AS other_key FROM ev WHERE num % 6 = 0 AND (u * 7) % (SELECT max(user_id) + 1 FROM events) <> u),
mat AS (
  SELECT ev.*, w.company_id AS named, w.incorporated,
    CASE WHEN ev.u % 30 = 0 AND ev.sheet IS NOT NULL THEN ev.u END AS own
  FROM ev LEFT JOIN wat w ON w.name_key = ev.firm_key
),
fit AS (SELECT *, coalesce(incorporated - fact_day > 93, false) AS early FROM mat),
linked AS (
  SELECT num, doc_id, province, sheet, CASE WHEN named IS NOT NULL AND NOT early THEN named END AS company_id,
    CASE WHEN own IS NOT NULL AND NOT early THEN 'sheet' WHEN named IS NOT NULL AND NOT early THEN 'name' ELSE 'none' END AS via,
    CASE WHEN named IS NOT NULL AND early THEN named END AS suggestion
  FROM fit
),
obs AS (
  SELECT w.company_id, 'registry' AS source, doc_id, num, fact_day AS day, f.field, f.value FROM lab JOIN wat w ON w.name_key = firm_key,
    LATERAL (SELECT unnest([
      {'field': 'purpose', 'value': CASE WHEN t = 'signup' THEN 'COMERCIO AL POR MENOR ' || k END},
      {'field': 'address', 'value': CASE WHEN t IN ('signup', 'error') THEN 'CL EJEMPLO ' || k END},
      {'field': 'city', 'value': CASE t WHEN 'signup' THEN 'MADRID' WHEN 'error' THEN 'TOLEDO' END},
      {'field': 'capital', 'value': CASE WHEN t IN ('signup', 'purchase') THEN (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') END},
      {'field': 'status', 'value': CASE WHEN num % 97 = 0 THEN 'extinct' WHEN num % 89 = 0 THEN 'dissolved' END}]) AS f) x
  WHERE f.value IS NOT NULL
  UNION ALL
  SELECT company_id, 'watchlist', NULL, NULL, DATE '2024-01-01', f.field, f.value FROM wat,
    LATERAL (SELECT unnest([{'field': 'name', 'value': name_key}, {'field': 'address', 'value': 'CALLE EJEMPLO ' || (company_id % 40)},
      {'field': 'city', 'value': 'MADRID'}, {'field': 'capital', 'value': '100.00'}, {'field': 'status', 'value': 'active'}]) AS f) x
),
ext AS (SELECT o.* FROM obs o WHERE field = 'status' AND value = 'extinct' AND EXISTS (SELECT 1 FROM ev WHERE ev.u = o.company_id AND ev.fact_day > o.day)),
outl AS (
  SELECT * FROM ext UNION ALL
  SELECT o.* FROM obs o WHERE field = 'status' AND value = 'dissolved' AND EXISTS (SELECT 1 FROM ext e WHERE e.company_id = o.company_id AND e.day = o.day)
),
now AS (
  SELECT * FROM (
    SELECT o.*, row_number() OVER (PARTITION BY company_id, field ORDER BY source = 'registry' DESC, day DESC,
      CASE WHEN field = 'status' THEN list_position(['active', 'insolvency', 'dissolved', 'extinct'], value) ELSE 0 END DESC, coalesce(doc_id, '') DESC, coalesce(num, 0) DESC) AS rn
    FROM obs o WHERE NOT EXISTS (SELECT 1 FROM outl x WHERE x.company_id = o.company_id AND x.field = o.field AND x.day = o.day AND x.value = o.value AND x.source = o.source)
  ) WHERE rn = 1
),
sites AS (SELECT min(company_id) AS company_id, arg_min(group_id, company_id) AS group_id, company_id % 40 AS portal FROM wat GROUP BY company_id % 40),
addr AS (SELECT num, u, firm_key, group_id, 'EJEMPLO ' || portal || ' (MADRID)' AS label FROM ev JOIN sites ON portal = k WHERE t = 'signup'),
ment AS (SELECT num, u, firm_key, group_id, 'owned_by "EMPRESA ' || o || ' SL"' AS evidence FROM (SELECT num, u, firm_key, (u * 7) % (SELECT max(user_id) + 1 FROM events) AS o FROM ev WHERE num % 6 = 0) JOIN wat ON company_id = o),
tok AS (SELECT num, u, firm_key, group_id, 'token "EMPRESA ' || u || '"' AS evidence FROM ev JOIN wat ON company_id = u),
sig AS (
  SELECT num, u, firm_key, group_id, 'mention' AS reason, 0 AS r FROM ment UNION ALL SELECT num, u, firm_key, group_id, 'address', 1 FROM addr UNION ALL SELECT num, u, firm_key, group_id, 'token', 2 FROM tok
),
det AS (SELECT num, any_value(u) AS u, any_value(firm_key) AS firm_key, arg_min(reason, r) AS reason, arg_min(group_id, r) AS group_id FROM sig GROUP BY num)
"""

_POSITIONS = (
    _EV
    + """, f AS (SELECT *, CASE WHEN kind = 'appointment' THEN 1 ELSE 0 END AS opens, CASE role WHEN 'auditor' THEN 'auditor' WHEN 'sole_director' THEN 'sole' END AS seat,
        CASE role WHEN 'sole_director' THEN 'sole' WHEN 'joint_several_director' THEN 'joint_several' WHEN 'board_member' THEN 'board' WHEN 'secretary' THEN 'board' END AS form FROM pos),
      last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id, holder, role ORDER BY day DESC, event_id DESC) AS rn FROM f) WHERE rn = 1 AND opens = 1),
      seats AS (SELECT company_id, seat, max(day) AS seat_day FROM f WHERE opens = 1 AND seat IS NOT NULL GROUP BY ALL),
      days AS (SELECT DISTINCT company_id, day FROM f WHERE opens = 1 AND form IS NOT NULL),
      out_of AS (SELECT d.company_id, g.form, max(d.day) AS left_day FROM days d, (VALUES ('board'), ('joint'), ('joint_several'), ('sole')) g(form)
        WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.company_id = d.company_id AND f.day = d.day AND f.form = g.form AND f.opens = 1) GROUP BY ALL)
      SELECT l.company_id, l.event_id, l.role, l.holder FROM last l LEFT JOIN seats s ON s.company_id = l.company_id AND s.seat = l.seat
        LEFT JOIN out_of o ON o.company_id = l.company_id AND o.form = l.form WHERE coalesce(seat_day <= l.day, true) AND coalesce(left_day <= l.day, true)"""
)

ORACLE_SQL = {
    "q_acts_by_type": _EV + "SELECT act_type, scope, count(*) AS n FROM acts GROUP BY ALL",
    "q_inscription_lag": _EV + "SELECT num % 15 AS days, count(*) AS n FROM ev GROUP BY ALL",
    "q_lag_quantiles": _EV + "SELECT 0.1::DOUBLE AS q, quantile_disc(num % 15, 0.1) AS days FROM ev UNION ALL SELECT 0.5, quantile_disc(num % 15, 0.5) FROM ev UNION ALL SELECT 0.9, quantile_disc(num % 15, 0.9) FROM ev",
    "q_sheet_parts": _EV + "SELECT doc_id, num, sheet, strftime(fact_day, '%Y-%m-%d') AS inscribed FROM ev",
    "q_name_key": _EV + "SELECT firm_key, count(*) AS n, count(DISTINCT num % 7) AS spellings FROM ev GROUP BY 1",
    "q_amounts": _EV + "SELECT num, CASE t WHEN 'signup' THEN 'incorporation' ELSE 'capital_increase' END AS act_type, cents FROM ev WHERE t IN ('signup', 'purchase')",
    "q_observations": _EV
    + """SELECT field, value, count(*) AS n FROM (
      SELECT 'purpose' AS field, 'COMERCIO AL POR MENOR ' || k AS value FROM ev WHERE t = 'signup' UNION ALL
      SELECT 'address', 'CL EJEMPLO ' || k FROM ev WHERE t IN ('signup', 'error') UNION ALL
      SELECT 'city', CASE t WHEN 'signup' THEN 'MADRID' ELSE 'TOLEDO' END FROM ev WHERE t IN ('signup', 'error') UNION ALL
      SELECT 'status', CASE WHEN num % 97 = 0 THEN 'extinct' ELSE 'dissolved' END FROM ev WHERE num % 97 = 0 OR num % 89 = 0) GROUP BY 1, 2""",
    "q_holders": _EV + "SELECT event_id AS num, role, label, holder, false AS is_company, kind FROM pos",
    "q_priorities": _EV
    + """SELECT act_type, CASE WHEN scope IN ('attorney', 'auditor') THEN 'low' WHEN act_type IN ('extinction', 'dissolution') THEN 'high'
      WHEN act_type IN ('website', 'erratum') THEN 'low' ELSE 'medium' END AS priority, count(*) AS n FROM acts GROUP BY 1, 2""",
    "q_document_counts": _EV
    + """SELECT e.doc_id, announcements, with_sheet, CAST(0 AS BIGINT) AS with_prefix, acts FROM
      (SELECT doc_id, count(*) AS announcements, count(sheet) AS with_sheet FROM ev GROUP BY 1) e JOIN (SELECT doc_id, count(*) AS acts FROM acts GROUP BY 1) a USING (doc_id)""",
    "q_exact_match": _EV + "SELECT num, company_id, via, suggestion, CASE WHEN suggestion IS NULL THEN 0.0 ELSE 100.0 END::DOUBLE AS score FROM linked WHERE company_id IS NOT NULL OR suggestion IS NOT NULL",
    "q_fixpoint_links": _EV
    + """SELECT 'PROVINCE ' || (i % 5) AS province, 'M ' || i AS sheet, CAST(i AS BIGINT) AS company_id FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 30 = 0) r(i)
      UNION SELECT province, sheet, company_id FROM linked WHERE via = 'name' AND sheet IS NOT NULL AND num % 97 <> 0""",
    "q_incremental_links": _EV.replace("WITH ev", "WITH RECURSIVE ev")
    + """, own(c, u) AS (
        SELECT company_id, company_id FROM wat
        UNION SELECT c, own.u + 1 FROM own JOIN ev ON ev.u = own.u JOIN wat ON company_id = c
        WHERE num % 31 = 0 AND own.u % 3 <> 2 AND (own.u + 1) % 10 <> 0 AND NOT coalesce(incorporated - fact_day > 93, false)),
      m AS (SELECT own.c, ev.*, coalesce(incorporated - fact_day > 93, false) AS early FROM own JOIN ev ON ev.u = own.u JOIN wat ON company_id = c),
      learned AS (SELECT DISTINCT c, province, sheet, u FROM m WHERE NOT early AND sheet IS NOT NULL AND num % 97 <> 0 AND u % 30 <> 0)
      SELECT 'sheet' AS kind, province || '|' || sheet AS key, c AS company_id, CAST(1 AS BIGINT) AS n FROM learned
      UNION ALL SELECT 'alias', 'EMPRESA ' || u || ' SL', c, 1 FROM own WHERE u <> c
      UNION ALL SELECT 'links', CASE WHEN m.sheet IS NOT NULL AND (m.u % 30 = 0 OR l.c IS NOT NULL) THEN 'sheet' ELSE 'name' END, m.c, count(*) FROM m LEFT JOIN learned l ON l.sheet = m.sheet AND l.province = m.province WHERE NOT early GROUP BY 2, 3""",
    "q_blocked_site": _EV + "SELECT num, group_id, label FROM addr",
    "q_token_signal": _EV + "SELECT num, group_id, evidence FROM tok",
    "q_mentions": _EV + "SELECT num, group_id, evidence FROM ment",
    "q_relations": _EV + "SELECT firm_key, 'owned_by' AS kind, other_key, count(*) AS n FROM rel GROUP BY ALL",
    "q_closure": _EV.replace("WITH ev", "WITH RECURSIVE ev")
    + """, e AS (SELECT DISTINCT other_key AS src, firm_key AS dst FROM rel),
      walk(seeds, node, group_id, depth) AS (
        SELECT seeds, name_key, group_id, 0 FROM wat, (VALUES ('all'), ('lower')) s(seeds) WHERE seeds = 'all' OR company_id * 2 < (SELECT max(user_id) + 1 FROM events)
        UNION SELECT seeds, dst, group_id, depth + 1 FROM walk JOIN e ON src = node WHERE depth < 40)
      SELECT seeds, node, group_id, depth FROM (SELECT *, row_number() OVER (PARTITION BY seeds, node ORDER BY depth, group_id) AS rn FROM walk) WHERE rn = 1 AND depth > 0""",
    "q_record_now": _EV + "SELECT company_id, field, source, value, strftime(day, '%Y-%m-%d') AS day FROM now",
    "q_outlived": _EV + "SELECT company_id, value, strftime(day, '%Y-%m-%d') AS day, num FROM outl",
    "q_proposals": _EV
    + """SELECT 'registry' AS why, company_id, field, held, value AS proposed FROM (
        SELECT n.company_id, n.field, n.value, CASE n.field WHEN 'address' THEN 'CALLE EJEMPLO ' || (n.company_id % 40) WHEN 'city' THEN 'MADRID' WHEN 'capital' THEN '100.00' WHEN 'status' THEN 'active' WHEN 'name' THEN 'EMPRESA ' || n.company_id || ' SL' END AS held
        FROM now n WHERE source = 'registry') WHERE CASE field WHEN 'address' THEN replace(value, 'CL ', 'CALLE ') ELSE value END IS DISTINCT FROM held""",
    "q_positions": _POSITIONS,
    "q_powers_spread": _EV
    + "SELECT company_id % 3 AS group_id, holder AS holder_plain, strftime(day, '%Y-%m-%d') AS day, kind, count(DISTINCT company_id) AS companies FROM pos GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT company_id) >= 2",
    "q_shared_members": _EV
    + """, g AS (SELECT DISTINCT holder, company_id % 3 AS group_id FROM pos WHERE company_id % 10 = 0),
      c AS (SELECT company_id, group_id, count(*) AS shared FROM (SELECT DISTINCT company_id, holder FROM pos) p JOIN g USING (holder) GROUP BY 1, 2 HAVING count(*) >= 3)
      SELECT 'EMPRESA ' || company_id || ' SL' AS firm_key, group_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY shared DESC, group_id) AS rn FROM c) WHERE rn = 1""",
    "q_sheet_stability": _EV
    + """, s AS (SELECT u, num, num % 97 = 0 AS x, num % 97 <> 0 AND num % 89 = 0 AS d FROM ev WHERE sheet IS NOT NULL),
      w AS (SELECT *, coalesce(bool_or(x) OVER b, false) AS hx, coalesce(bool_or(d) OVER b, false) AS hd FROM s WINDOW b AS (PARTITION BY u ORDER BY num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT count(*) AS with_sheet, CAST(0 AS BIGINT) AS after_rename, CAST(0 AS BIGINT) AS after_rename_other_name, count(*) FILTER (WHERE hx) AS after_extinction, count(*) FILTER (WHERE hd) AS after_dissolution,
        CAST(0 AS BIGINT) AS name_differs_without_rename, CAST(0 AS BIGINT) AS renamed_sheets, count(*) FILTER (WHERE x AND NOT hx) AS extinct_sheets, count(*) FILTER (WHERE d AND NOT hd) AS dissolved_sheets, count(DISTINCT u) AS distinct_sheets FROM w""",
    "q_cascade": _EV
    + """SELECT CASE WHEN company_id IS NOT NULL THEN 'watched' WHEN suggestion IS NOT NULL THEN 'review' WHEN sheet = 'M 11' THEN 'candidate' WHEN det.num IS NOT NULL THEN 'candidate' ELSE 'discard' END AS kept_as, count(*) AS n
      FROM linked LEFT JOIN det USING (num) GROUP BY 1""",
    "q_name_lengths": _EV
    + """SELECT 'A' AS section, CAST(length(CAST(u AS VARCHAR)) + list_element([11, 14, 26, 17, 26, 25, 18], CAST(num % 7 + 1 AS INTEGER)) AS INTEGER) AS length, count(*) AS n FROM ev GROUP BY 1, 2""",
    "q_role_coverage": _EV + "SELECT label, count(*) AS n, any_value(role) AS role FROM pos GROUP BY 1",
    "q_incorporation_lag": _EV + "SELECT fact_day - DATE '2024-01-01' AS days, count(*) AS n FROM ev WHERE t = 'signup' GROUP BY 1",
    "q_registered_addresses": _EV + "SELECT 'EJEMPLO ' || k || CASE t WHEN 'signup' THEN ' (MADRID)' ELSE ' (TOLEDO)' END AS label, count(DISTINCT u) AS companies FROM ev WHERE t IN ('signup', 'error') GROUP BY 1",
    "q_pair_counts": _EV + "SELECT CASE k % 20 WHEN 0 THEN 'ALFA PERSONA' ELSE 'BRAVO PERSONA' END AS pair, count(DISTINCT u) AS n FROM ev WHERE t IN ('view', 'click') AND k % 20 < 2 GROUP BY 1",
    "q_signal_hits": _EV
    + """, h AS (SELECT reason, firm_key, arg_min(group_id, num) AS group_id FROM (SELECT num, firm_key, group_id, reason FROM sig UNION ALL SELECT num, firm_key, group_id, 'detector' FROM det) GROUP BY 1, 2)
      SELECT reason, group_id, count(*) AS firms FROM h GROUP BY 1, 2""",
    "q_lead_aggregates": _EV
    + """SELECT CAST(i AS BIGINT) AS lead_id, CASE WHEN n > 0 THEN n ELSE 5 END AS notice_count, strftime(coalesce(a, DATE '2023-01-01'), '%Y-%m-%d') AS first_day, strftime(coalesce(b, DATE '2023-01-02'), '%Y-%m-%d') AS last_day
      FROM range(0, 30) r(i) LEFT JOIN (SELECT num % 20 AS l, count(*) AS n, min(fact_day) AS a, max(fact_day) AS b FROM ev GROUP BY 1) ON l = i""",
    "q_token_noise": _EV
    + """, t AS (SELECT CAST(i AS VARCHAR) AS key FROM range(0, 10) r(i) UNION ALL SELECT 'EMPRESA')
      SELECT key, count(DISTINCT u) AS n FROM t LEFT JOIN (SELECT DISTINCT u FROM ev WHERE u >= 20) x ON key = CAST(u AS VARCHAR) OR key = 'EMPRESA' GROUP BY 1""",
    "q_address_noise": _EV
    + """SELECT 'EJEMPLO ' || portal || ' (MADRID)' AS key, coalesce(n, 0) AS n FROM sites LEFT JOIN
      (SELECT label, count(DISTINCT u) AS n FROM addr WHERE firm_key NOT IN (SELECT name_key FROM wat) GROUP BY 1) a ON label = 'EJEMPLO ' || portal || ' (MADRID)'""",
    "q_collisions": """
      WITH p AS (SELECT upper(p_name) AS name, p_partkey FROM part), s AS (SELECT * FROM p WHERE ('0x' || substr(md5(name), 1, 8))::UBIGINT % 3 = 0)
      SELECT least(length(name), 20) AS length, least(len(string_split(name, ' ')), 4) AS n_words, count(*) AS names, count(h) AS hits
      FROM (SELECT DISTINCT name FROM s) a LEFT JOIN (SELECT DISTINCT name AS h FROM s) b ON h = name GROUP BY 1, 2""",
    "q_bands": """
      SELECT CASE WHEN d < 0 THEN 'before' WHEN d < 31 THEN '0-30' WHEN d < 91 THEN '31-90' WHEN d < 181 THEN '91-180' WHEN d < 366 THEN '181-365' WHEN d < 731 THEN '366-730' WHEN d < 1826 THEN '731-1825' ELSE '1826+' END AS band, count(*) AS n
      FROM (SELECT CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS d FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY 1""",
    "q_histogram": """
      SELECT CASE WHEN c <= 0 THEN '<=0' WHEN c <= 2 THEN '1-2' WHEN c <= 5 THEN '3-5' WHEN c <= 10 THEN '6-10' WHEN c <= 20 THEN '11-20' WHEN c <= 50 THEN '21-50' WHEN c <= 200 THEN '51-200' ELSE '>200' END AS bin, count(*) AS n
      FROM (SELECT count(*) AS c FROM events GROUP BY user_id) GROUP BY 1""",
    "q_detect": _EV + "SELECT num, reason, group_id FROM det",
    "q_eval": _EV
    + """, fl AS (SELECT reason, firm_key, any_value(u) AS u, arg_min(group_id, num) AS group_id FROM sig GROUP BY 1, 2),
      tr AS (SELECT i, i % 3 AS g, EXISTS (SELECT 1 FROM ev WHERE u = i) AS reachable FROM range(0, 60) r(i)),
      tot AS (SELECT count(*) FILTER (WHERE reachable) AS reach FROM tr)
      SELECT reason, count(*) AS flagged, count(*) FILTER (WHERE g = group_id) AS true_positive, count(*) FILTER (WHERE g <> group_id) AS wrong_group,
        count(*) FILTER (WHERE g = group_id) / count(*) AS precision, count(*) FILTER (WHERE g = group_id AND reachable) / any_value(reach) AS recall
      FROM fl LEFT JOIN tr ON i = u, tot GROUP BY 1""",
    "q_triage": _EV
    + """, l AS (SELECT d.u AS lead_id, any_value(d.firm_key) AS firm, arg_min(d.group_id, d.num) AS group_id, arg_min(d.reason, d.num) AS reason, count(*) AS n, max(day) AS last_day FROM det d JOIN ev USING (num) GROUP BY 1),
      b AS (SELECT *, coalesce(lead_id % 10 = 0 AND lead_id % 3 = group_id, false) AS brand FROM l),
      s AS (SELECT *, round((1 - (1 - CASE reason WHEN 'mention' THEN 0.9 WHEN 'address' THEN 0.5 ELSE 1.0 / 3 END) * CASE WHEN brand AND reason <> 'token' THEN 1 - 1.0 / 3 ELSE 1.0 END)
        * pow(0.5, greatest(DATE '2024-03-31' - last_day, 0) / 180.0) * log2(1 + n), 4) AS score FROM b),
      p AS (SELECT *, row_number() OVER (ORDER BY score DESC, group_id, firm, lead_id) AS place, count(*) OVER () AS total FROM s)
      SELECT lead_id, reason, brand, round(score, 3) AS score, CASE WHEN score <= 0 THEN 'rest' WHEN place <= round_even(total * 0.2, 0) THEN 'first' WHEN place <= round_even(total * 0.2, 0) + round_even(total * 0.3, 0) THEN 'next' ELSE 'rest' END AS tier FROM p""",
    "q_timeline_entry": _EV
    + """, fact AS (
        SELECT u AS c, fact_day AS day, num, 'incorporated' AS kind, false AS g FROM ev WHERE t = 'signup' UNION ALL
        SELECT u, fact_day, num, 'owner', o % 3 = u % 3 FROM rel UNION ALL
        SELECT company_id, day, event_id, CASE kind WHEN 'appointment' THEN 'body_in' ELSE 'body_out' END, false FROM pos WHERE role NOT IN ('attorney', 'auditor', 'secretary')),
      one AS (SELECT c, min(day) FILTER (WHERE kind = 'incorporated') AS founded, min(day) FILTER (WHERE kind = 'owner' AND g) AS sign FROM fact GROUP BY 1),
      two AS (SELECT f.c, min(abs(f.day - sign)) FILTER (WHERE kind = 'body_out') AS gap, bool_or(kind = 'owner' AND NOT g AND f.day < sign) AS outside, bool_or(kind = 'incorporated' AND f.day < sign) AS before FROM fact f JOIN one USING (c) GROUP BY 1),
      m AS (SELECT i AS company_id, i = 0 AS is_head, CASE WHEN i % 20 = 0 THEN DATE '2024-04-20' END AS inc, founded, sign, gap, outside, before FROM (SELECT DISTINCT user_id FROM events) r(i) LEFT JOIN one ON one.c = i LEFT JOIN two ON two.c = i),
      r AS (SELECT *, CASE WHEN is_head THEN 'head' WHEN sign - founded <= 365 THEN 'founded' WHEN sign IS NOT NULL AND (coalesce(outside, false) OR coalesce(before, false) OR coalesce(gap <= 30, false)) THEN 'acquired'
        WHEN sign IS NULL THEN 'untied' WHEN inc IS NOT NULL THEN 'listed' ELSE 'already_in' END AS rule FROM m),
      d AS (SELECT *, CASE rule WHEN 'head' THEN coalesce(inc, founded) WHEN 'founded' THEN founded WHEN 'acquired' THEN sign WHEN 'listed' THEN inc END AS entry FROM r)
      SELECT company_id, rule, strftime(entry, '%Y-%m-%d') AS entry_day,
        CASE WHEN entry IS NOT NULL AND rule IN ('founded', 'acquired') THEN 'owner' WHEN entry IS NOT NULL OR inc IS NOT NULL OR founded IS NOT NULL THEN 'incorporation' END AS evidence,
        CASE WHEN entry IS NULL THEN false WHEN rule = 'head' THEN inc IS NULL WHEN rule IN ('founded', 'acquired') THEN true ELSE false END AS confirmed,
        CAST(year(coalesce(entry, inc, founded)) AS INTEGER) AS year FROM d""",
    "q_upsert_notices": _EV
    + """, m AS (SELECT num, company_id, suggestion, CASE WHEN company_id IS NOT NULL THEN 'watched' WHEN suggestion IS NOT NULL THEN 'review' ELSE 'discarded' END AS kept FROM linked),
      o AS (SELECT * FROM m WHERE num % 3 <> 0), n AS (SELECT num, CASE WHEN num % 4 = 0 THEN company_id END AS company_id FROM m WHERE num % 2 = 0 OR num % 3 = 0),
      j AS (SELECT coalesce(n.company_id, o.company_id) AS company_id, o.suggestion, CASE WHEN coalesce(n.company_id, o.company_id) IS NOT NULL THEN 'watched' WHEN n.num IS NOT NULL THEN 'discarded' ELSE o.kept END AS kept_as FROM o FULL JOIN n USING (num))
      SELECT kept_as, count(*) AS n, count(company_id) AS linked, count(suggestion) AS suggested FROM j GROUP BY 1""",
    "q_relink": _EV + "SELECT num, CAST(substr(sheet, 3) AS BIGINT) AS company_id FROM linked WHERE company_id IS NULL AND CAST(substr(sheet, 3) AS BIGINT) % 7 = 0",
    "q_prune": _EV + "SELECT num % 50 AS lead_id, count(*) AS n FROM linked WHERE company_id IS NOT NULL OR suggestion IS NOT NULL OR (num % 50) % 5 = 0 GROUP BY 1",
    "q_derived_words": """
      WITH w AS (SELECT source AS name, lang = 'en' AS marked, unnest(string_split(regexp_replace(text, '[\\x09-\\x0D]', ' ', 'g'), ' ')) AS word FROM documents)
      SELECT word, count(*) AS n, count(*) FILTER (WHERE marked) AS n_marked, count(DISTINCT name) AS n_names FROM w WHERE word <> '' GROUP BY 1 HAVING count(*) >= 200 AND count(DISTINCT name) >= 10 AND count(*) FILTER (WHERE marked) >= count(*) * 0.8""",
    "q_token_cuts": _EV
    + """, t AS (SELECT CAST(i AS VARCHAR) AS key FROM range(0, 10) r(i) UNION ALL SELECT 'EMPRESA'),
      z AS (SELECT key, count(DISTINCT u) AS n FROM t LEFT JOIN (SELECT DISTINCT u FROM ev WHERE u >= 20) x ON key = CAST(u AS VARCHAR) OR key = 'EMPRESA' GROUP BY 1),
      a AS (SELECT n, count(*) AS keys, sum(length(key)) AS related FROM z GROUP BY 1)
      SELECT n AS threshold, CAST(sum(keys) OVER (ORDER BY n) AS BIGINT) AS keys, CAST(sum(related) OVER (ORDER BY n) AS BIGINT) AS related, CAST(sum(n * keys) OVER (ORDER BY n) AS BIGINT) AS unrelated FROM a""",
    "q_name_grams": """
      WITH w AS (SELECT string_split(upper(p_name), ' ') AS w FROM part)
      SELECT gram, count(*) AS n FROM (SELECT unnest(w) AS gram FROM w UNION ALL SELECT w[i] || ' ' || w[i + 1] FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w)) GROUP BY 1""",
    "q_fuzzy_best": """
      WITH RECURSIVE p AS (SELECT upper(p_name) AS name, p_partkey FROM part),
      b AS (SELECT name AS close, min(p_partkey) AS pos FROM p GROUP BY 1),
      t AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN substr(name, 1, length(name) // 2) || substr(name, length(name) // 2 + 2) WHEN 1 THEN name || right(name, 1) ELSE name END AS base FROM p),
      c AS (SELECT base, close, pos FROM t JOIN b ON levenshtein(base, close) <= (length(base) + length(close)) // 10),
      l AS (
        SELECT base, close, pos, 0 AS i, list_transform(range(length(close)), lambda x: 0) AS r FROM c
        UNION ALL
        SELECT base, close, pos, i + 1, list_transform(range(1, length(close) + 1), lambda j: list_max(list_transform(range(1, j + 1),
          lambda k: greatest(r[k], CASE WHEN k > 1 THEN r[k - 1] ELSE 0 END + CASE WHEN substr(close, k, 1) = substr(base, i + 1, 1) THEN 1 ELSE 0 END)))) FROM l WHERE i < length(base)),
      s AS (SELECT base, close, pos, 200.0::DOUBLE * r[length(close)] / (length(base) + length(close)) AS score FROM l WHERE i = length(base))
      SELECT base, close, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY score DESC, pos) AS n FROM s WHERE score >= 90) WHERE n = 1""",
    "q_read_documents": _EV
    + """SELECT e.doc_id, day, province, announcements, with_sheet, acts FROM
      (SELECT doc_id, strftime(any_value(day), '%Y-%m-%d') AS day, any_value(province) AS province, count(*) AS announcements, count(sheet) AS with_sheet FROM ev GROUP BY 1) e JOIN (SELECT doc_id, count(*) AS acts FROM acts GROUP BY 1) a USING (doc_id)""",
    "q_landing": _EV
    + """SELECT strftime(day, '%Y-%m-%d') AS day, 'published' AS status, count(DISTINCT doc_id) AS n_documents, count(*) AS announcements FROM ev GROUP BY 1
      UNION ALL SELECT strftime(d, '%Y-%m-%d'), 'not_cached', 0, 0 FROM (SELECT unnest(generate_series(min(day), max(day) + INTERVAL 2 DAY, INTERVAL 1 DAY)) AS d FROM ev) WHERE d NOT IN (SELECT day FROM ev)""",
    "q_ingest": _EV + "SELECT strftime(day, '%Y-%m-%d') AS day, 'published' AS status, count(DISTINCT doc_id) AS n_documents, count(*) AS announcements, count(sheet) AS with_sheet FROM ev GROUP BY 1",
    "q_section_b": _EV
    + """SELECT 'GZ-B-' || strftime(day, '%Y%m%d') || '-00' AS doc_id, num, firm_key AS firm, CASE WHEN num % 4 = 0 THEN 'OTRA ' || u || ' SA' ELSE '' END AS others, strftime(day, '%Y-%m-%d') AS inscribed,
        'merger_project' AS act_type, CASE WHEN num % 4 = 0 THEN 'Listed with: OTRA ' || u || ' SA. ' ELSE '' END || 'Proyecto ' || t AS detail FROM ev""",
    "q_rebuild": _EV.replace("WITH ev", "WITH RECURSIVE ev")
    + """, asked AS (SELECT DISTINCT 'EMPRESA ' || u AS base FROM mat WHERE own IS NULL AND named IS NULL),
      pairs AS (SELECT base, close FROM asked, (SELECT DISTINCT 'EMPRESA ' || company_id AS close FROM wat) WHERE levenshtein(base, close) <= (length(base) + length(close)) // 10),
      lcs AS (
        SELECT base, close, 0 AS i, list_transform(range(length(close)), lambda x: 0) AS r FROM pairs
        UNION ALL
        SELECT base, close, i + 1, list_transform(range(1, length(close) + 1), lambda j: list_max(list_transform(range(1, j + 1),
          lambda k: greatest(r[k], CASE WHEN k > 1 THEN r[k - 1] ELSE 0 END + CASE WHEN substr(close, k, 1) = substr(base, i + 1, 1) THEN 1 ELSE 0 END)))) FROM lcs WHERE i < length(base)),
      near AS (SELECT DISTINCT base FROM lcs WHERE i = length(base) AND 200 * r[length(close)] >= 90 * (length(base) + length(close))),
      lnk AS (SELECT linked.*, linked.suggestion IS NOT NULL OR linked.company_id IS NULL AND near.base IS NOT NULL AS suggested FROM linked JOIN ev USING (num) LEFT JOIN near ON near.base = 'EMPRESA ' || ev.u),
      fol AS (SELECT DISTINCT province, sheet FROM lnk JOIN det USING (num) WHERE company_id IS NULL AND NOT suggested AND reason = 'mention' AND sheet IS NOT NULL),
      kept AS (SELECT CASE WHEN l.company_id IS NOT NULL THEN 'watched' WHEN l.suggested THEN 'review' WHEN fol.sheet IS NOT NULL OR det.num IS NOT NULL THEN 'candidate' ELSE 'discard' END AS part
        FROM lnk l LEFT JOIN det USING (num) LEFT JOIN fol ON fol.sheet = l.sheet AND fol.province = l.province)
      SELECT part, count(*) AS n FROM kept GROUP BY 1
      UNION ALL SELECT 'sheets', count(*) FROM (SELECT 'M ' || i AS sheet FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 30 = 0) r(i) UNION SELECT sheet FROM linked WHERE via = 'name' AND sheet IS NOT NULL AND num % 97 <> 0)
      UNION ALL SELECT 'values', count(*) FROM (SELECT DISTINCT o.doc_id, o.company_id, field, day, value FROM obs o JOIN linked l USING (num) WHERE l.company_id IS NOT NULL)
      UNION ALL SELECT 'events', count(*) FROM pos JOIN linked ON event_id = num WHERE linked.company_id IS NOT NULL
      UNION ALL SELECT 'leads', count(DISTINCT u) FROM det JOIN lnk USING (num) WHERE company_id IS NULL AND NOT suggested""",
    "q_rebuild_history": _EV
    + """, o AS (SELECT obs.* FROM obs JOIN linked l USING (num) WHERE l.company_id IS NOT NULL),
      e AS (SELECT * FROM o WHERE field = 'status' AND value = 'extinct' AND EXISTS (SELECT 1 FROM ev JOIN linked l USING (num) WHERE l.company_id = o.company_id AND ev.fact_day > o.day)),
      x AS (SELECT * FROM e UNION ALL SELECT * FROM o WHERE field = 'status' AND value = 'dissolved' AND EXISTS (SELECT 1 FROM e WHERE e.company_id = o.company_id AND e.day = o.day)),
      r AS (SELECT *, row_number() OVER (PARTITION BY company_id, field ORDER BY day DESC, CASE WHEN field = 'status' THEN list_position(['active', 'insolvency', 'dissolved', 'extinct'], value) ELSE 0 END DESC, doc_id DESC, num DESC) AS rn
        FROM o WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.company_id = o.company_id AND x.field = o.field AND x.day = o.day AND x.value = o.value))
      SELECT company_id, field, value, strftime(day, '%Y-%m-%d') AS day FROM r WHERE rn = 1""",
    "q_watched_lookup": _EV + "SELECT num, coalesce(own, named) AS watched_id FROM mat WHERE own IS NOT NULL OR named IS NOT NULL",
    "q_address_use": _EV
    + """SELECT 'EJEMPLO ' || portal || ' (MADRID)' AS label, coalesce(a.n, 0) AS unrelated, coalesce(a.r, 0) AS related, coalesce(a.n, 0) < 6 AS used FROM sites LEFT JOIN
      (SELECT label, count(DISTINCT CASE WHEN u % 10 <> 0 THEN u END) AS n, count(DISTINCT CASE WHEN u % 10 = 0 THEN u END) AS r FROM addr GROUP BY 1) a ON label = 'EJEMPLO ' || portal || ' (MADRID)'""",
    "q_role_labels": _EV + "SELECT replace(lower(label), '.', '') AS label, any_value(role) AS role, count(*) AS n FROM pos GROUP BY 1 HAVING count(*) >= 10",
    "q_stream_positions": _POSITIONS,
    "q_differs": "SELECT event_id % 7 AS m, (event_id % 7) IN (1, 5) AS differs, count(*) AS n FROM events GROUP BY 1, 2",
}
