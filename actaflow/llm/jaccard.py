"""Exact n-gram Jaccard join with a token-group matrix.

Similar documents are partitioned into groups; the matrix tells which tokens
(shingle hashes) each group's union holds.  A document can only be similar to a
member of a group whose union holds enough of its tokens: the query-group
overlap bounds the similarity, and only groups that reach the bound are opened.

1.  Texts are dealt to blocks; the distinct tokens of each block meet by hash,
    and each document learns how many of its tokens any other block, or another
    set of its own block, has.  Documents for which the union of *all* others
    doesn't reach the bound are done: for most of a corpus that is all.
2.  Equal sets become one; min-hash bands propose for each set the smallest sets
    of its bands, and the proposals that an exact count confirms make the groups.
3.  The same exchange, now with the group of each token, keeps the sets whose
    tokens in *other* groups reach the bound.
4.  Those ask groups that have one of their rarest tokens (as many as must contain
    a match).  A group comes in chunks of members of like size, each with its
    token union; a chunk is opened, and counts are exact, if the union holds as
    many of the asking set's tokens as a set of that size would have to share.
5.  Components over the confirmed links.

The sizes of what is dealt to one task are bounded everywhere: a token that a
third of all documents share is one entry per block, members of a group with a
third of all rows are opened in chunks, and neighbours are never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actaflow.llm.graph import connected_components
from actaflow.llm.store import checkpoint, settled
from actaflow.llm.words import MULT, WORD_HASHES, distinct, fingerprint, mix, shingle_set

SHINGLE = 5
PERCENT = 75
BLOCK_BYTES = 1 << 20
BUCKET_TOKENS = 4_000_000
MIN_BUCKETS = 24
BANDS, ROWS_PER_BAND = 8, 2
LEADERS = 2
#: Sets of one band are within this ratio of size.
SIZE_RATIO = 1.15
#: Rounds in which sets find leaders; what they miss is found in step 4, at a higher price.
ROUNDS = 4
#: Members of a group opened by one task, sets that ask there, members of a group kept in one block.
CHUNK, ASKING, ONE_BLOCK = 64, 128, 1000
_SEVERAL = -1


def needed(n, percent: int = PERCENT):
    """Tokens of a set of n that a similar set must share: |A & B| >= t |A | B| >= t n."""
    return -(-n * percent // 100)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(a) + len(b) - common)


class TokenBlock:
    """The token-group matrix of one block, ordered by bucket."""

    def __init__(self, sets: list[np.ndarray], groups: list[int], buckets: int):
        self.lengths = [len(s) for s in sets]
        tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        group = np.repeat(np.array(groups, np.int64), self.lengths)
        sort = np.argsort(tokens)
        tokens, group = tokens[sort], group[sort]
        new = np.ones(len(tokens), bool)
        np.not_equal(tokens[1:], tokens[:-1], out=new[1:])
        first = np.flatnonzero(new)
        unique, inverse = tokens[first], np.empty(len(tokens), np.int64)
        inverse[sort] = np.cumsum(new) - 1
        low = np.minimum.reduceat(group, first) if len(first) else group
        high = np.maximum.reduceat(group, first) if len(first) else group
        bucket = ((unique >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.inverse, self.bucket = rank[inverse], bucket[order]
        self.several = (low != high)[order]
        self.group = np.where(low != high, _SEVERAL, low)[order]
        self.key = unique[order].astype(np.uint32)  # the low half; the bucket is of the high one
        self.begin = np.concatenate([[0], np.flatnonzero(np.diff(self.bucket)) + 1]).astype(int) if len(order) else np.empty(0, int)

    def entries(self, block: int, with_groups: bool) -> pa.Table:
        out = []
        for a, b in zip(self.begin, [*self.begin[1:], len(self.key)]):
            out.append((int(self.bucket[a]), block, self.key[a:b].tobytes(), self.group[a:b].tobytes() if with_groups else b""))
        columns = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "block", "keys", "groups"])

    def shared(self, replies: pa.Table) -> list[np.ndarray]:
        """For each set, which of its tokens another group has."""
        known, begin = self.several.copy(), {int(self.bucket[a]): int(a) for a in self.begin}
        for bucket, at in zip(replies.column("bucket").to_pylist(), replies.column("at").to_pylist()):
            known[begin[bucket] + np.frombuffer(at, np.uint32).astype(np.int64)] = True
        flags = known[self.inverse]
        return np.split(flags, np.cumsum(self.lengths)[:-1]) if self.lengths else []


_ENTRIES = "bucket int, block long, keys binary, groups binary"


def _shared_tokens(table: pa.Table) -> pa.Table:
    """For one bucket: to each block those of its tokens that come in two groups
    (or, without groups, in two blocks)."""
    blocks = table.column("block").to_pylist()
    keys = [np.frombuffer(k, np.uint32) for k in table.column("keys").to_pylist()]
    groups = [np.frombuffer(g, np.int64) if len(g) else np.full(len(k), b) for g, k, b in zip(table.column("groups").to_pylist(), keys, blocks)]
    key, group = np.concatenate(keys), np.concatenate(groups)
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
    of = group[order]
    differs = np.minimum.reduceat(of, new) != np.maximum.reduceat(of, new)
    shared = np.empty(len(key), bool)
    shared[order] = np.repeat(differs, np.diff(np.append(new, len(key))))
    bucket, at, out = table.column("bucket")[0].as_py(), 0, []
    for block, k in zip(blocks, keys):
        hit = np.flatnonzero(shared[at : at + len(k)])
        if len(hit):
            out.append((block, bucket, hit.astype(np.uint32).tobytes()))
        at += len(k)
    columns = list(zip(*out)) or [()] * 3
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()))], names=["block", "bucket", "at"])


def _replies(entries: DataFrame) -> DataFrame:
    return entries.groupBy("bucket").applyInArrow(_shared_tokens, "block long, bucket int, at binary")


def _table(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, schema)], names=[n for n, _ in schema])


def _sets(docs: DataFrame, shingle: int, percent: int, block_bytes: int, bucket_tokens: int) -> DataFrame:
    """doc_id, key, n, fp, tokens: the tokens of those sets alone that may have a partner,
    once for each block."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_bytes))
    buckets = max(MIN_BUCKETS, -(-total // (6 * bucket_tokens)))
    texts = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    def read(table: pa.Table) -> tuple[list, dict, TokenBlock]:
        rows = []
        classes: dict[bytes, tuple[int, np.ndarray]] = {}
        for doc_id, key, text in zip(table.column("doc_id").to_pylist(), table.column("key").to_pylist(), table.column("text")):
            s = shingle_set(text.as_py(), WORD_HASHES, shingle)
            fp = fingerprint(s)
            rows.append((doc_id, key, len(s), fp))
            if len(s):
                classes.setdefault(fp, (len(classes), s))
        return rows, classes, TokenBlock([s for _, s in classes.values()], [k for k, _ in classes.values()], buckets)

    def index(key: tuple, table: pa.Table) -> pa.Table:
        return read(table)[2].entries(key[0].as_py(), False)

    kinds = [("doc_id", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("fp", pa.binary()), ("tokens", pa.binary())]

    def prune(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows, classes, block = read(table)
        shared = block.shared(replies)
        left = {fp: s for fp, (k, s) in classes.items() if shared[k].sum() >= needed(len(s), percent)}
        return _table([(i, key, n, fp, left.pop(fp).tobytes() if fp in left else None) for i, key, n, fp in rows], kinds)

    entries = texts.groupBy("block").applyInArrow(index, _ENTRIES)
    return texts.groupBy("block").cogroup(_replies(entries).groupBy("block")).applyInArrow(prune, "doc_id long, key binary, n long, fp binary, tokens binary")


def _band_keys(sets: DataFrame) -> DataFrame:
    """(rep, band, key): min-hashes of the set, two to a band, for sets of like size."""
    seeds = [np.uint64(((2 * i + 1) * int(MULT)) & (2**64 - 1)) for i in range(BANDS * ROWS_PER_BAND)]
    kinds = [("rep", pa.int64()), ("keys", pa.list_(pa.int64()))]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rep, tokens in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = np.frombuffer(tokens.as_py(), np.uint64)
                low = np.array([mix(t * s).min() for s in seeds], np.uint64).reshape(BANDS, ROWS_PER_BAND)
                like = np.uint64(np.log(len(t)) / np.log(SIZE_RATIO))
                rows.append((rep, mix(low[:, 0] * MULT + low[:, 1] + like).view(np.int64).tolist()))
            yield from _table(rows, kinds).to_batches()

    keys = sets.select("rep", "tokens").mapInArrow(fn, "rep long, keys array<long>")
    return keys.select("rep", F.posexplode("keys").alias("band", "key"))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar."""
    left = sets.select(F.col("rep").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("tokens").alias("y"))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(fn, "a long, b long")


def _round(bands: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links of each set to the leaders of its bands.

    A band's leader is its most central set: the one whose bands hold the most
    sets.  Among edited copies of a text this is the least edited one, which is
    closer to the others than they are to one another."""
    # counts and leaders are written first: a join whose sides are only read is split by
    # rows where a band is crowded
    held = checkpoint(bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"))
    crowded = checkpoint(bands.join(held, ["band", "key"]))
    central = crowded.groupBy("rep").agg(F.sum("held").alias("central"))
    crowded = checkpoint(crowded.drop("held").join(central, "rep"))
    leaders = crowded.groupBy("band", "key").agg(F.max(F.struct("central", (-F.col("rep")).alias("fallen"))).alias("top")).select("band", "key", (-F.col("top.fallen")).alias("leader"), F.col("top.central").alias("weight"))
    leaders = checkpoint(leaders)
    proposed = checkpoint(crowded.join(leaders, ["band", "key"]).filter("rep <> leader").select("rep", "leader", "weight"))
    proposed = proposed.groupBy("rep", "leader").agg(F.count(F.lit(1)).alias("bands"), F.max("weight").alias("weight"))
    order = Window.partitionBy("rep").orderBy(F.desc("bands"), F.desc("weight"), "leader")
    best = proposed.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= LEADERS)
    return _confirm(best.select(F.col("rep").alias("a"), F.col("leader").alias("b")), sets, percent)


def _star_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links that make the groups: rounds of proposals, each among the sets that the
    rounds before have left alone, so that texts in the shadow of a larger family of
    almost similar ones find leaders of their own."""
    bands, links = checkpoint(_band_keys(sets)), None
    for _ in range(ROUNDS):
        found = settled(sets.sparkSession, lambda: _round(bands, sets, percent))
        links = found if links is None else checkpoint(links.unionByName(found))
        if found.isEmpty():
            break
        grouped = found.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        bands = checkpoint(bands.join(grouped, "rep", "left_anti"))
    return links


def _asking(sets: DataFrame, percent: int, bucket_tokens: int) -> DataFrame:
    """rep, g, g_size, n, shared (array): sets whose tokens in other groups reach the bound."""
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    blocks, buckets = max(1, -(-total // 200_000)), max(MIN_BUCKETS, -(-total // bucket_tokens))
    whole = F.when(F.col("g_size") <= ONE_BLOCK, F.xxhash64("g")).otherwise(F.xxhash64("rep"))
    rows = sets.select("rep", "g", "g_size", "n", "tokens", F.pmod(whole, F.lit(blocks)).alias("block"))

    def read(table: pa.Table) -> tuple[list[np.ndarray], TokenBlock]:
        tokens = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
        return tokens, TokenBlock(tokens, table.column("g").to_pylist(), buckets)

    def index(key: tuple, table: pa.Table) -> pa.Table:
        return read(table)[1].entries(key[0].as_py(), True)

    kinds = [("rep", pa.int64()), ("g", pa.int64()), ("g_size", pa.int64()), ("n", pa.int64()), ("shared", pa.list_(pa.int64()))]

    def prune(table: pa.Table, replies: pa.Table) -> pa.Table:
        tokens, block = read(table)
        out = []
        for rep, g, size, n, t, s in zip(*(table.column(c).to_pylist() for c in ("rep", "g", "g_size", "n")), tokens, block.shared(replies)):
            if s.sum() >= needed(n, percent):
                out.append((rep, g, size, n, t[s].view(np.int64)))
        return _table(out, kinds)

    entries = rows.groupBy("block").applyInArrow(index, _ENTRIES)
    return rows.groupBy("block").cogroup(_replies(entries).groupBy("block")).applyInArrow(prune, "rep long, g long, g_size long, n long, shared array<long>")


def _to_open(asking: DataFrame, percent: int) -> DataFrame:
    """(rep, g2): groups that may hold a set similar to this one.

    Tokens are ordered by the number of groups that have them, the rarest first.
    Of two similar sets, the first n - t n + 1 tokens of the larger and the first
    n - 2t/(1+t) n + 1 of the smaller have one in common, so each group is entered
    under those tokens of its members alone; of two groups the smaller one asks.  From
    their first common token on, both must have as many tokens left as sets of their
    sizes have to share."""
    tokens = asking.select("rep", "g", "g_size", "n", F.explode("shared").alias("token"))
    rarity = tokens.groupBy("token", "g").agg(F.lit(1).alias("one")).groupBy("token").agg(F.count(F.lit(1)).alias("n_groups")).filter("n_groups > 1")
    of = Window.partitionBy("rep")
    ranked = tokens.join(rarity, "token").withColumn("rank", F.row_number().over(of.orderBy("n_groups", "token"))).withColumn("left", F.count(F.lit(1)).over(of))
    as_larger = F.col("left") - F.ceil(F.col("n") * percent / 100) + 1
    as_smaller = F.col("left") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)) + 1
    prefix = checkpoint(ranked.filter(F.col("rank") <= as_larger).select("rep", "g", "g_size", "n", "token", (F.col("rank") <= as_smaller).alias("smaller"), (F.col("left") - F.col("rank") + 1).alias("rest")))
    entered = prefix.groupBy("token", F.col("g").alias("g2"), F.col("g_size").alias("g2_size")).agg(F.max("smaller").alias("smaller2"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest2"))
    asks = (F.col("g") != F.col("g2")) & ((F.col("g_size") < F.col("g2_size")) | ((F.col("g_size") == F.col("g2_size")) & (F.col("g") < F.col("g2"))))
    sized = (F.col("high") * 100 >= F.col("n") * percent) & (F.col("low") * percent <= F.col("n") * 100)
    share = (F.col("n") + F.greatest(F.col("low"), F.ceil(F.col("n") * percent / 100))) * percent
    enough = (F.least("rest", "rest2") * (100 + percent)) >= share
    return prefix.join(entered, "token").filter(asks & sized & (F.col("smaller") | F.col("smaller2")) & enough).select("rep", "g2").distinct()


def _open(opened: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links of the asking sets to members of the groups that they ask.

    A group is kept in chunks of members of like size.  Each chunk's token union
    bounds the overlap: only if it holds the tokens that a set of the smallest
    size in the chunk would have to share is the chunk opened, up to the first
    similar member, as the members are linked with one another."""
    chunk = F.struct(F.floor(F.log(1.05, F.col("n"))).alias("of_size"), F.pmod(F.xxhash64("rep"), F.ceil(F.col("g_size") / CHUNK).cast("long")).alias("nth"))
    asked = opened.groupBy("g2").agg(F.count(F.lit(1)).alias("asking"))
    # written by themselves, joins on a crowded group are split by their rows
    members = checkpoint(sets.join(asked, F.col("g") == F.col("g2")).withColumn("chunk", chunk))
    salts = F.ceil(F.col("asking") / ASKING).cast("long")
    chunks = members.groupBy("g2", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(salts).alias("salts"))
    queries = opened.join(sets.select("rep", "n", "tokens"), "rep").join(chunks, "g2").filter((F.col("high") * 100 >= F.col("n") * percent) & (F.col("low") * percent <= F.col("n") * 100))
    queries = checkpoint(queries)
    queries = queries.select("g2", "chunk", F.pmod(F.xxhash64("rep"), F.col("salts")).alias("salt"), "rep", "tokens", F.lit(False).alias("member"))
    members = members.select("g2", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), "rep", "tokens", F.lit(True).alias("member"))

    def fn(table: pa.Table) -> pa.Table:
        rows = [(r, np.frombuffer(t, np.uint64), m) for r, t, m in zip(*(table.column(c).to_pylist() for c in ("rep", "tokens", "member")))]
        inside, out = [(r, t) for r, t, m in rows if m], []
        if not inside or len(inside) == len(rows):
            return _table([], _LINK)
        union = distinct(np.concatenate([t for _, t in inside]))
        least = min(len(t) for _, t in inside)
        for rep, tokens, member in rows:
            if not member:
                bound = max(needed(len(tokens), percent), -(-percent * (len(tokens) + least) // (100 + percent)))
                at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
                if (union[at] == tokens).sum() >= bound:
                    hit = next((r for r, t in inside if similar(tokens, t, percent)), None)
                    if hit is not None:
                        out.append((rep, hit))
        return _table(out, _LINK)

    return members.unionByName(queries).groupBy("g2", "chunk", "salt").applyInArrow(fn, "a long, b long")


_LINK = [("a", pa.int64()), ("b", pa.int64())]


#: From here on a set is named by its digest: none of its rows has a doc_id.
_UNNAMED = 1 << 62


def _components(rows: DataFrame, percent: int, bucket_tokens: int) -> DataFrame:
    """fp, n_same, component: the smallest name reachable, for every set of ``rows``.

    A set's name is its smallest doc_id or, if it has none, a number above all of them."""
    unnamed = F.lit(_UNNAMED) + F.xxhash64("fp").bitwiseAND(F.lit(_UNNAMED - 1))
    classes = rows.filter("n > 0").groupBy("fp").agg(F.coalesce(F.min("doc_id"), unnamed).alias("rep"), F.count(F.lit(1)).alias("n_same"))
    sets = rows.filter("tokens is not null").groupBy("fp").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    sets = checkpoint(sets.join(classes, "fp").select("rep", "n", "tokens"))
    spark = rows.sparkSession
    links = settled(spark, lambda: _star_links(sets, percent))
    groups = settled(spark, lambda: connected_components(links))
    grouped = sets.join(groups, sets["rep"] == groups["node"], "left").select("rep", "n", "tokens", F.coalesce("component", "rep").alias("g"))
    sizes = grouped.groupBy("g").agg(F.count(F.lit(1)).alias("g_size"))
    grouped = checkpoint(grouped.join(sizes, "g"))
    opened = settled(spark, lambda: _to_open(checkpoint(_asking(grouped, percent, bucket_tokens)), percent))
    more = settled(spark, lambda: _open(opened, grouped, percent))
    found = groups if more.isEmpty() else connected_components(links.unionByName(more))
    return classes.join(found, classes["rep"] == found["node"], "left").select("fp", "n_same", F.coalesce("component", "rep").alias("component"))


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """doc_id, n_shingles, component_id, n_same: one row for each input row.

    ``component_id`` is the smallest doc_id reachable over links of Jaccard
    similarity ``percent`` or more between shingle sets; ``n_same`` counts the
    rows with an equal set, itself included.  Null, empty and blank texts have an
    empty set and are linked with nothing.  Repeated rows are linked like copies; rows
    with a null doc_id are linked like any other, but name no component: one of such
    rows alone is null.  An empty table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("key"), F.col("text").cast("string").alias("text"))
    rows = checkpoint(_sets(docs, shingle, percent, block_bytes, bucket_tokens))
    out = rows.select("doc_id", "n", "fp").join(_components(rows, percent, bucket_tokens), "fp", "left")
    none, named = F.col("n") == 0, F.when(F.col("component") < _UNNAMED, F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(none, F.col("doc_id")).otherwise(named).alias("component_id"), F.when(none, F.lit(1)).otherwise(F.col("n_same")).alias("n_same"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """One row of each component, with all its columns: the one of the smallest doc_id
    (null last), of those the one of the smallest text digest, and of equal rows any.
    Rows with an empty set stay, whatever their ids."""
    key = F.unhex(F.sha2(F.col("text").cast("string"), 256))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.col("text").cast("string").alias("text"))

    def placed() -> DataFrame:
        rows = checkpoint(_sets(keyed, shingle, percent, block_bytes, bucket_tokens))
        of_row = rows.filter("n > 0").groupBy("fp", "doc_id", "key").agg(F.count(F.lit(1)).alias("n_rows"))
        at = F.struct(F.coalesce("doc_id", F.lit(_UNNAMED)).alias("order"), "key").alias("at")
        return of_row.join(_components(rows, percent, bucket_tokens), "fp").select("component", at, "doc_id", "key", "n_rows")

    of_row = settled(docs.sparkSession, placed)
    first = of_row.groupBy(F.col("component").alias("_component")).agg(F.min("at").alias("_first"))
    lost = (F.col("at") != F.col("_first")).alias("_lost")
    verdicts = of_row.join(first, F.col("component") == F.col("_component")).select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), lost, "n_rows")
    verdicts = verdicts.filter("_lost or n_rows > 1").select("_doc", "_key", "_lost")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_doc")) & (F.unhex(F.sha2(docs["text"].cast("string"), 256)) == F.col("_key"))
    if verdicts.filter("not _lost").isEmpty():
        return docs.join(verdicts, same, "left_anti")
    names = [f"_{i}" for i in range(len(docs.columns))]
    judged = docs.join(verdicts, same, "left").select(*(docs[c].alias(n) for c, n in zip(docs.columns, names)), "_lost").filter("_lost is null or not _lost")
    once = judged.filter("not _lost").dropDuplicates([names[docs.columns.index("doc_id")], names[docs.columns.index("text")]])
    return judged.filter("_lost is null").unionByName(once).drop("_lost").toDF(*docs.columns)


#: For tables in which a doc_id names one row.
JACCARD_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {SHINGLE} THEN [list_aggregate(words, 'string_agg', ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(words) - {SHINGLE - 2}), lambda i: list_aggregate(words[i:i + {SHINGLE - 1}], 'string_agg', ' ')))) END AS shingles
  FROM w
),
t AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM t x JOIN t y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= {PERCENT} * (x.n + y.n - count(*))
),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS node FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.node = e.a),
c AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, len(shingles) AS n_shingles, component_id,
  CASE WHEN len(shingles) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY shingles) END AS n_same
FROM s JOIN c USING (doc_id)
"""
