"""Signals that an unwatched company may belong to a watched group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actaflow.functions import catalogue as C
from actaflow.functions.places import same_site, site
from actaflow.functions.text import name_grams, name_key, possible_pairs, split_form, usable_words
from actaflow.operators.facts import observations, slots
from actaflow.operators.tables import cut_lineage, first_by


def mention_keys(names: DataFrame, min_chars: int = C.BARE_MIN_CHARS, min_words: int = C.BARE_MIN_WORDS) -> DataFrame:
    """(key, group_id) from (name, group_id, pos): each name's key, and the key without its
    form if enough of it is left; the first name in ``pos`` keeps a key, its full key first."""
    n = names.withColumn("key", name_key(F.col("name"))).filter("key <> ''")
    parts = split_form(F.col("key"))
    bare = (parts["form"].isNotNull()) & (F.char_length(parts["base"]) >= min_chars) & (F.size(F.split(parts["base"], " ")) >= min_words)
    both = n.select("group_id", "pos", F.posexplode(F.filter(F.array(F.col("key"), F.when(bare, parts["base"])), lambda k: k.isNotNull())).alias("at", "key"))
    return first_by(both, ["key"], ["pos", "at"]).select("key", "group_id")


def mentions(acts: DataFrame, holdings: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, num, group_id, evidence): the first slot, in act order, whose whole name is a
    watched one."""
    named = slots(acts, holdings).select("*", F.explode(F.array(name_key(F.col("name")))).alias("key")).filter("key <> ''").join(keys, "key")
    best = F.min_by(F.struct("group_id", F.concat(F.col("kind"), F.lit(' "'), F.col("key"), F.lit('"')).alias("evidence")), F.struct("seq", "at"))
    return named.groupBy("doc_id", "num").agg(best.alias("b")).select("doc_id", "num", "b.*")


def registered_addresses(acts: DataFrame) -> DataFrame:
    """(doc_id, num, seq, street, city): where an incorporation or change of address registers
    it, as printed; an address without either is no site."""
    a = acts.filter(F.col("act_type").isin("address_change", "incorporation")).select("*", F.explode(F.array(observations(F.col("act_type"), F.col("detail")))).alias("_o"))
    said = lambda f: F.get(F.filter("_o", lambda x: x["field"] == f), F.lit(0))["value"]
    return a.select("doc_id", "num", "seq", said("address").alias("street"), said("city").alias("city")).filter("street is not null and city is not null")


def _placed(addresses: DataFrame, generic: Column | None) -> DataFrame:
    return addresses.select("*", F.explode(F.array(site(F.col("street"), F.col("city"), generic, from_registry=True))).alias("site")).filter("site is not null")


def registered_sites(acts: DataFrame, generic: Column | None = None) -> DataFrame:
    """(doc_id, num, seq, site): where an incorporation or change of address registers it."""
    return _placed(registered_addresses(acts), generic).select("doc_id", "num", "seq", "site")


def watched_sites(addresses: DataFrame, generic: Column | None = None) -> DataFrame:
    """(pos, group_id, known) from (pos, group_id, street, city)."""
    return addresses.select("pos", "group_id", F.explode(F.array(site(F.col("street"), F.col("city"), generic))).alias("known")).filter("known is not null")


def site_pairs(seen: DataFrame, known: DataFrame, generic: Column | None = None) -> DataFrame:
    """(site, known) of each watched site that is a registered site, one row for a pair of
    different sites, however many announcements and companies have them.

    Candidates share a (municipality, telling word or kilometre point) and a portal: an
    equi-join, verified pair by pair."""
    keyed = lambda df, c: df.select(c).distinct().select(c, F.col(f"{c}.place.portal").alias("portal"), F.explode(f"{c}.marks").alias("mark"))
    pairs = keyed(seen, "site").join(keyed(known, "known"), ["mark", "portal"])
    return pairs.filter(same_site(F.col("known"), F.col("site"), generic)).select("site", "known").distinct()


def at_watched_sites(seen: DataFrame, known: DataFrame, noise: DataFrame | None = None, generic: Column | None = None, noise_max: int = C.ADDRESS_NOISE_MAX) -> DataFrame:
    """(doc_id, num, seq, group_id, label): the first watched site that a registered site is,
    unless it is crowded.

    ``seen``: registered_sites, or registered_addresses, of which each is placed once, however
    many announcements print it."""
    seen = cut_lineage(seen)
    keys = [c for c in ("site", "street", "city") if c in seen.columns]
    places = seen.select(*keys).distinct()
    if "site" not in keys:
        places = cut_lineage(_placed(places, generic))
    firsts = cut_lineage(first_by(known.select("known", "pos", "group_id"), ["known"], ["pos"]))
    found = first_by(site_pairs(places, firsts, generic).join(firsts, "known").select("site", "pos", "group_id", F.col("known.label").alias("label")), ["site"], ["pos"])
    if "site" not in keys:
        found = places.join(found, "site").drop("site")
    hits = first_by(seen.join(found, keys).select("doc_id", "num", "seq", "pos", "group_id", "label"), ["doc_id", "num", "seq"], ["pos"]).drop("pos")
    if noise is not None:
        hits = hits.join(noise.filter(F.col("n") >= noise_max).select("label"), "label", "left_anti").select("doc_id", "num", "seq", "group_id", "label")
    return hits


def address_signal(hits: DataFrame) -> DataFrame:
    best = F.min_by(F.struct("group_id", F.concat(F.lit("at "), F.col("label")).alias("evidence")), "seq")
    return hits.groupBy("doc_id", "num").agg(best.alias("b")).select("doc_id", "num", "b.*")


def token_signal(announcements: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, num, group_id, evidence): the first gram of the name, pairs first, that is an
    approved token.  A name is read once, however many announcements print it."""
    printed = cut_lineage(announcements.select("doc_id", "num", "firm"))
    grams = printed.select("firm").distinct().select("firm", F.explode(F.array(name_grams(F.col("firm")))).alias("_g"))
    grams = grams.select("firm", F.posexplode("_g").alias("at", "token")).join(tokens, "token")
    best = F.min_by(F.struct("at", "group_id", F.concat(F.lit('token "'), F.col("token"), F.lit('"')).alias("evidence")), "at")
    found = printed.join(grams.groupBy("firm").agg(best.alias("b")), "firm")
    return found.groupBy("doc_id", "num").agg(F.min_by("b", "b.at").alias("b")).select("doc_id", "num", "b.group_id", "b.evidence")


def pairs_in(texts: DataFrame, pairs: DataFrame, keys: tuple[str, ...] = ("doc_id", "num")) -> DataFrame:
    """(keys, pair): kept word pairs of which a text has both words.  A pair is entered under
    its first word, and the other one is looked for in the text's own words."""
    words = texts.select(*keys, F.array_distinct(usable_words(F.col("text"))).alias("_w"))
    filed = pairs.select("pair", F.substring_index("pair", " ", 1).alias("_a"), F.substring_index("pair", " ", -1).alias("_b")).distinct()
    return words.select(*keys, "_w", F.explode("_w").alias("_a")).join(filed, "_a").filter(F.array_contains("_w", F.col("_b"))).select(*keys, "pair").distinct()


def person_signal(texts: DataFrame, pairs: DataFrame, personal: DataFrame) -> DataFrame:
    """(doc_id, num, group_id, evidence): the smallest surname pair found, unless the sole
    shareholder is a natural person."""
    found = pairs_in(texts, pairs).join(personal.select("doc_id", "num"), ["doc_id", "num"], "left_anti").join(pairs, "pair")
    return found.groupBy("doc_id", "num").agg(F.min_by("group_id", "pair").alias("group_id")).withColumn("evidence", F.lit("officer surname pair"))


def personal_holdings(acts: DataFrame) -> DataFrame:
    """(doc_id, num): the first owner that an announcement states is a natural person."""
    from actaflow.functions.text import ends_as_company

    owners = slots(acts).filter("kind = 'owned_by'")
    first = owners.groupBy("doc_id", "num").agg(F.min_by("name", F.struct("seq", "at")).alias("owner"))
    return first.filter(~ends_as_company(F.col("owner"))).select("doc_id", "num")


def best_pair(names: DataFrame, word_counts: DataFrame, pair_counts: DataFrame) -> DataFrame:
    """(name, pair, n): the pair that stands for a person, of the rarest words, then in the
    fewest companies, then the first."""
    p = names.select("name", F.explode(possible_pairs(F.col("name"))).alias("pair"))
    p = p.withColumns({"a": F.substring_index("pair", " ", 1), "b": F.substring_index("pair", " ", -1)})
    wa, wb = word_counts.select(F.col("word").alias("a"), F.col("n").alias("na")), word_counts.select(F.col("word").alias("b"), F.col("n").alias("nb"))
    p = p.join(wa, "a", "left").join(wb, "b", "left").join(pair_counts.select("pair", "n"), "pair", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return p.groupBy("name").agg(F.min(F.struct((zero("na") + zero("nb")).alias("rarity"), zero("n").alias("n"), "pair")).alias("b")).select("name", "b.pair", "b.n")


def detect(signals: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, num, reason, group_id, evidence): the most reliable signal that fires."""
    every = None
    for rank, name in enumerate(C.SIGNALS):
        if name in signals:
            rows = signals[name].select("doc_id", "num", F.lit(rank).alias("rank"), F.lit(name).alias("reason"), "group_id", "evidence")
            every = rows if every is None else every.unionByName(rows)
    return first_by(every, ["doc_id", "num"], ["rank"]).drop("rank")


def upsert_leads(old: DataFrame, found: DataFrame) -> DataFrame:
    """Leads by (firm_key, province): one found again keeps its group, signal and evidence,
    and opens again if it was gone.  ``found`` has one row for each announcement."""
    new = found.groupBy("firm_key", "province").agg(
        F.min_by(F.struct("group_id", "reason", "evidence", "firm"), F.struct("fact_day", "doc_id", "num")).alias("b"),
        F.min("fact_day").alias("since"), F.max("fact_day").alias("until"), F.count(F.lit(1)).alias("n"),
    )
    j = old.alias("o").join(new.alias("n"), ["firm_key", "province"], "full")
    keep = lambda a, b: F.coalesce(F.col(f"o.{a}"), F.col(f"n.{b}"))
    state = F.when(F.col("o.state").isNull() | ((F.col("o.state") == "gone") & F.col("n.n").isNotNull()), "open").otherwise(F.col("o.state"))
    return j.select(
        "firm_key", "province", keep("group_id", "b.group_id").alias("group_id"), keep("reason", "b.reason").alias("reason"), keep("evidence", "b.evidence").alias("evidence"),
        keep("firm", "b.firm").alias("firm"), F.least("o.first_day", "n.since").alias("first_day"), F.greatest("o.last_day", "n.until").alias("last_day"), state.alias("state"),
    )
