"""URL rules answered by Bloom filter cascades.

A rule is a host and a path prefix; it fits a URL of that host or a subdomain
whose path starts with the prefix.  Every URL has a bounded list of keys (host
suffix of as many labels x path prefix of as many characters as some rule has),
and over the distinct keys of the corpus -- the complete universe -- a cascade of
Bloom filters makes membership exact: level 1 encodes the listed keys, level 2 the
keys of the universe that level 1 takes wrongly, level 3 the listed keys that
level 2 takes wrongly, and so on until a level takes none wrongly.  A lookup walks
the levels down to the first miss, whose parity is the answer; it needs no join.

Level 1 has log2(universe / listed) + 1/2 hash functions, so that it takes about
as many keys wrongly as there are listed ones; the bits of all levels together
are then O(listed * log(universe / listed)), however large the corpus is.  A list
of more than ``shard_keys`` keys is split into shards by a hash of the key; a level
has one filter for each shard, all built in one pass, and a key is looked up in its
shard's.  All of it runs in DataFrame functions; the filters, about four bytes for
each listed key, are what travels to the driver and in the plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actaflow.llm.store import checkpoint

#: Listed keys that share one filter of a level.
SHARD_KEYS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards)).cast("int") if shards > 1 else F.lit(0)


@dataclass(frozen=True)
class Level:
    """A Bloom filter for each shard, of as many bits each: words as decimal lists."""

    words: tuple[str, ...]
    bits: int
    hashes: int
    seed: int

    def hit(self, key: Column) -> Column:
        filters = F.array(*(F.split(F.lit(w), ",").cast("array<bigint>") for w in self.words))
        positions = _positions(key, self.bits, self.hashes, self.seed)
        held = lambda words, p: F.getbit(F.element_at(words, (F.shiftright(p, 6) + 1).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1
        # bound once, so that the plan holds the filters once for all hash functions
        of_shard = F.array(F.element_at(filters, shard_of(key, len(self.words)) + 1))
        return F.exists(of_shard, lambda words: F.forall(F.array(*positions), lambda p: held(words, p)))


def _positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(bits)) for i in range(hashes)]


def _level(keys: DataFrame, n: int, rate: float, seed: int, shards: int) -> Level:
    """Filters over the distinct keys, at a rate of wrong answers; n is of the fullest shard."""
    hashes = max(1, math.ceil(-math.log2(rate)))
    bits = 64 * max(1, math.ceil(n * hashes / math.log(2) / 64))
    position = F.explode(F.array(*_positions(F.col("key"), bits, hashes, seed)))
    rows = (
        keys.select(shard_of(F.col("key"), shards).alias("shard"), position.alias("p"))
        .groupBy("shard", F.shiftright("p", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("value"))
        .collect()
    )
    words = [[0] * (bits // 64) for _ in range(shards)]
    for shard, word, value in rows:
        words[shard][word] = value
    return Level(tuple(",".join(map(str, w)) for w in words), bits, hashes, seed)


def _fullest(keys: DataFrame, shards: int) -> int:
    """Keys of the shard that has the most; 0 if there are none."""
    sizes = keys.groupBy(shard_of(F.col("key"), shards).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]


def build_cascade(listed: DataFrame, universe: DataFrame, n_universe: int, shard_keys: int = SHARD_KEYS) -> list[Level]:
    """Levels for the keys of ``listed`` against the keys of ``universe``."""
    listed = listed.select("key").distinct()
    n = listed.count()
    if not n:
        return []
    shards = -(-n // shard_keys)
    levels = [_level(listed, _fullest(listed, shards), min(0.5, n / max(1, n_universe) / math.sqrt(2)), 0, shards)]
    own = listed
    taken = universe.filter(levels[0].hit(F.col("key"))).select("key", F.lit(False).alias("own")).unionByName(listed.withColumn("own", F.lit(True)))
    other = taken.groupBy("key").agg(F.max("own").alias("own")).filter("not own").select("key")
    while True:
        other = checkpoint(other)
        n = _fullest(other, shards)
        if not n:
            return levels
        levels.append(_level(other, n, 0.5, len(levels), shards))
        own, other = other, own.filter(levels[-1].hit(F.col("key")))


def member(levels: list[Level], key: Column) -> Column:
    """Exact for keys of the universe: the parity of the first level that misses."""
    answer = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        answer = F.when(~levels[i].hit(key), F.lit(i % 2 == 1)).otherwise(answer)
    return answer


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.char_length(host) - F.char_length(F.replace(host, F.lit("."), F.lit(""))) + 1


def url_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys of a URL, longest first (then the one with the longer host): one for each
    of the rules' shapes (labels of the host, characters of the path) that it reaches."""
    keys = []
    for labels, n in shapes:
        suffix = F.substring_index(host, ".", -labels)
        key = F.struct((-F.char_length(suffix) - n).alias("order"), (-F.char_length(suffix)).alias("of_host"), F.concat(suffix, F.substring(path, 1, n)).alias("key"))
        keys.append(F.when((_labels(host) >= labels) & (F.char_length(path) >= n), key))
    return F.transform(F.array_sort(F.array_compact(F.array(*keys))), lambda x: x["key"])


def url_filter(pages: DataFrame, rules: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """page_id, host, path, rule, verdict: one row for each row of ``pages``.

    ``rules`` has action (block or allow), host and path.  The longest fitting
    rule decides; a key under both actions blocks.  A URL that no rule fits is
    allowed, a null URL or one without ``://`` has an empty host and path (which
    only a rule with an empty host would fit).  Repeated rows are judged each on
    its own; an empty rule table allows everything, and a rule with a null host or
    path is none.  Other columns of either table are not read.
    """
    host = F.translate("host", _UPPER, _LOWER)
    rules = rules.select("action", F.concat(host, F.col("path")).alias("key"), _labels(host).alias("labels"), F.char_length("path").alias("n")).filter("key is not null")
    shapes = sorted((r["labels"], r["n"]) for r in rules.select("labels", "n").distinct().collect())
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not shapes:
        return urls.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit("allow"))
    keyed = urls.withColumn("keys", url_keys(F.col("host"), F.col("path"), shapes))
    universe = keyed.select(F.explode("keys").alias("key"))
    n = universe.agg(F.approx_count_distinct("key").alias("n")).first()["n"]
    cascades = {a: build_cascade(rules.filter(F.col("action") == a), universe, n, shard_keys) for a in ("block", "allow")}

    def found(k: Column) -> Column:
        verdict = F.lit(None).cast("string")
        for a in ("allow", "block"):
            if cascades[a]:
                verdict = F.when(member(cascades[a], k), F.lit(a)).otherwise(verdict)
        return verdict

    hits = F.filter(F.transform("keys", lambda k: F.struct(k.alias("rule"), found(k).alias("verdict"))), lambda x: x["verdict"].isNotNull())
    best = F.get("hits", F.lit(0))
    return keyed.withColumn("hits", hits).select(
        "page_id", "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit("allow")).alias("verdict")
    )


RULES_SQL = """
SELECT * FROM VALUES
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'),
  ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'),
  ('block', 'org', '/es/') AS t(action, host, path)
"""

URL_FILTER_SQL = """
WITH u AS (
  SELECT page_id,
    CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
),
r(action, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'),
    ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
),
m AS (
  SELECT page_id, host, path, action, rhost || rpath AS rule,
    row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC NULLS LAST) AS n
  FROM u LEFT JOIN r ON (host = rhost OR suffix(host, '.' || rhost)) AND prefix(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE n = 1
"""
