"""Substring dedup by relative Lempel-Ziv parsing over indexed reference blocks.

Documents are dealt to blocks by a hash.  Every block is a reference: its index
holds each phrase of ``window`` consecutive words once, with the smallest doc_id of
the block that has it.  The index entries of all blocks meet by phrase hash, so that
a document is parsed against every block at once: each of its positions learns two
earlier documents in which the phrase that begins there stands, the first of all and
the nearest one before.

The parse goes from left to right.  At a position whose phrase an earlier document
has it takes the longer of the two factors that those documents supply phrase by
phrase, and goes on behind it; elsewhere it goes on by a word.  Factors are disjoint
and of a window's length at least; inside of one nothing is looked up.  A window that
begins in a factor and ends behind it can have a source of its own: those, fewer than
a window's words at each factor's end, are looked up one by one.  The duplicate spans
are the factors and the windows found at their boundaries.  No other window is left:
where the parse went on by a word it had looked and found nothing.

What moves: the texts once, by block (both passes read the same exchange), and
eight bytes for each distinct phrase of a block.  A phrase that a third of all
documents share is one entry per block.  Entries are dealt by one hash and
compared by another of 64 bits, so different phrases do not meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actaflow.llm.words import MULT, WORD_HASHES, mix, split_words, window_hashes

WINDOW = 13
BLOCK_BYTES = 1 << 20
BUCKET_PHRASES = 1_500_000
MIN_BUCKETS = 24
_OTHER_MULT = np.uint64(0xD6E8FEB86659FD93)
_LAST = np.iinfo(np.int64).max


def _bucket_of(h: np.ndarray, window: int, buckets: int) -> np.ndarray:
    out = h[: len(h) - window + 1].copy()
    for k in range(1, window):
        out *= _OTHER_MULT
        out += h[k : len(h) - window + 1 + k]
    return (mix(out ^ MULT) % np.uint64(buckets)).astype(np.int32)


class BlockIndex:
    """The phrases of a block: distinct ones, ordered by bucket and smallest document."""

    def __init__(self, table: pa.Table, window: int, buckets: int):
        rows = zip(table.column("doc_id").to_pylist(), table.column("text"))
        self.docs = sorted(((i, split_words(t.as_py())) for i, t in rows), key=lambda d: (_LAST if d[0] is None else d[0], d[1]))
        hashes = WORD_HASHES
        keys, bucket, owner = [], [], []
        self.starts = [0]
        for n, (_, words) in enumerate(self.docs):
            h = hashes.of(words)
            w = window_hashes(h, window)
            if len(w):
                keys.append(w)
                bucket.append(_bucket_of(h, window, buckets))
                owner.append(np.full(len(w), n, np.int32))
            self.starts.append(self.starts[-1] + len(w))
        empty = np.empty(0, np.uint64)
        key = np.concatenate(keys) if keys else empty
        self.owner = np.concatenate(owner) if owner else empty.astype(np.int32)
        where = np.concatenate(bucket) if bucket else empty.astype(np.int32)
        # stable: the first of equal keys is of the smallest document
        _, first, self.inverse = np.unique(key, return_index=True, return_inverse=True)
        order = np.lexsort((self.owner[first], where[first]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.inverse = rank[self.inverse]
        first = first[order]
        self.key, self.bucket, self.first_owner = key[first], where[first], self.owner[first]
        self.ids = np.array([_LAST if i is None else i for i, _ in self.docs], np.int64)

    def entries(self, block: int) -> pa.Table:
        """One row for each bucket: documents, how many phrases each has there, and the phrases."""
        out = []
        cuts = np.flatnonzero(np.diff(self.bucket)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(self.bucket)]):
            if a < b:
                own, counts = np.unique(self.ids[self.first_owner[a:b]], return_counts=True)
                out.append((int(self.bucket[a]), block, own.tobytes(), counts.astype(np.uint32).tobytes(), self.key[a:b].tobytes()))
        columns = list(zip(*out)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "block", "ids", "counts", "keys"])

    def sources(self, replies: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each phrase of each document: whether an earlier document has it, the first
        one and the nearest one before (as far as the replies and this block know)."""
        first = self.ids[self.first_owner]
        near = np.full(len(first), -1, np.int64)  # of other blocks; known where there is one
        known = np.zeros(len(first), bool)
        begin = {int(self.bucket[a]): int(a) for a in ([0, *(np.flatnonzero(np.diff(self.bucket)) + 1)] if len(self.bucket) else [])}
        for bucket, at, ids, before in zip(*(replies.column(c).to_pylist() for c in ("bucket", "at", "ids", "near"))):
            at = begin[bucket] + np.frombuffer(at, np.uint32).astype(np.int64)
            first[at], near[at], known[at] = np.frombuffer(ids, np.int64), np.frombuffer(before, np.int64), True
        source, own = first[self.inverse], self.ids[self.owner]
        found = source < own
        nearest = source.copy()
        # documents of this block that have the phrase, in order; the first of them asks the others
        at = np.flatnonzero(found)
        at = at[np.argsort(self.inverse[at], kind="stable")]
        phrase, doc = self.inverse[at], own[at]
        new = np.ones(len(at), bool)
        new[1:] = phrase[1:] != phrase[:-1]
        start = new.copy()  # of the positions of one document
        start[1:] |= doc[1:] != doc[:-1]
        held = self.ids[self.first_owner[phrase]]
        before = np.where(held < doc, held, np.where(known[phrase], near[phrase], source[at]))
        later = np.flatnonzero(start & ~new)
        before[later] = doc[later - 1]
        nearest[at] = before[np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))] if len(at) else before
        return found, source, nearest


def _first_owners(table: pa.Table) -> pa.Table:
    """For one bucket: to each block the entries that an earlier document of another block
    has, with the first such document and the one next before."""
    blocks, keys = table.column("block").to_pylist(), [np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()]
    owner = np.concatenate([np.repeat(np.frombuffer(i, np.int64), np.frombuffer(c, np.uint32)) for i, c in zip(table.column("ids").to_pylist(), table.column("counts").to_pylist())])
    key = np.concatenate(keys)
    order = np.lexsort((owner, key))
    sorted_key, sorted_owner = key[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
    least, near = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    least[order] = np.repeat(sorted_owner[new], np.diff(np.append(new, len(key))))
    before = np.concatenate([sorted_owner[:1], sorted_owner[:-1]])
    near[order] = np.where(before < sorted_owner, before, least[order])  # of one id or of another key: the first
    later, at, out = least < owner, 0, []
    bucket = table.column("bucket")[0].as_py()
    for block, k in zip(blocks, keys):
        hit = np.flatnonzero(later[at : at + len(k)])
        if len(hit):
            out.append((block, bucket, hit.astype(np.uint32).tobytes(), least[at + hit].tobytes(), near[at + hit].tobytes()))
        at += len(k)
    columns = list(zip(*out)) or [()] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "bucket", "at", "ids", "near"])


def _run_ends(at: np.ndarray, source: np.ndarray) -> np.ndarray:
    """For each found position (by place in ``at``), the place behind the last one that
    follows it without a gap from the same source."""
    breaks = np.flatnonzero((np.diff(at) > 1) | (np.diff(source[at]) != 0)) + 1
    ends = np.append(breaks, len(at))
    return ends[np.searchsorted(breaks, np.arange(len(at)), side="right")]


def factors(found: np.ndarray, first: np.ndarray, near: np.ndarray, window: int) -> list[dict]:
    """Greedy factors (start, words, source) of one document: disjoint, from left to right,
    each the longer of those that the two sources of its first phrase supply."""
    at = np.flatnonzero(found)
    if not len(at):
        return []
    by_first, by_near = _run_ends(at, first), _run_ends(at, near)
    out, k = [], 0
    while k < len(at):
        source, end = (near, by_near[k]) if by_near[k] > by_first[k] else (first, by_first[k])
        start, words = int(at[k]), int(end - k) - 1 + window
        out.append({"start": start, "words": words, "source": int(source[at[k]])})
        k = int(np.searchsorted(at, start + words))
    return out


def boundary_windows(parsed: list[dict], found: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows that begin inside a factor, end behind it and stand in an
    earlier document."""
    last = np.array([f["start"] + f["words"] - window for f in parsed], np.int64)  # a factor's own last window
    at = (last[:, None] + np.arange(1, window)).ravel()
    at = at[at < len(found)]
    return at[found[at]]


def duplicate_spans(parsed: list[dict], found: np.ndarray, window: int) -> list[dict]:
    """(start, words) of the stretches that factors and the windows at their boundaries
    cover; stretches that touch or overlap are one."""
    if not parsed:
        return []
    more = boundary_windows(parsed, found, window)
    start = np.concatenate([np.array([f["start"] for f in parsed], np.int64), more])
    end = np.concatenate([np.array([f["start"] + f["words"] for f in parsed], np.int64), more + window])
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    cuts = np.flatnonzero(start[1:] > reach[:-1]) + 1
    first, last = np.append(0, cuts), np.append(cuts, len(start)) - 1
    return [{"start": int(a), "words": int(b - a)} for a, b in zip(start[first], reach[last])]


def substring_dedup(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, bucket_phrases: int = BUCKET_PHRASES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, factors, spans: one row for each input row.

    A word goes if a window that covers it also starts in a document with a
    smaller doc_id; ``factors`` are those of the greedy parse, ``spans`` the stretches
    that they and the windows at their boundaries make, which go.  Null and empty texts have no words; texts shorter than a window lose
    none.  Rows that share a doc_id are not earlier than each other; a null doc_id
    counts as later than any other.  Other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_bytes))
    buckets = max(MIN_BUCKETS, -(-total // (6 * bucket_phrases)))
    texts = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    def index(key: tuple, table: pa.Table) -> pa.Table:
        return BlockIndex(table, window, buckets).entries(key[0].as_py())

    def parse(table: pa.Table, replies: pa.Table) -> pa.Table:
        block = BlockIndex(table, window, buckets)
        found, first, near = block.sources(replies)
        out = []
        for n, (doc_id, words) in enumerate(block.docs):
            a, b = block.starts[n], block.starts[n + 1]
            parsed = factors(found[a:b], first[a:b], near[a:b], window)
            spans = duplicate_spans(parsed, found[a:b], window)
            kept, at = [], 0
            for s in spans:
                kept += words[at : s["start"]]
                at = s["start"] + s["words"]
            kept += words[at:]
            out.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept), parsed, spans))
        columns = list(zip(*out)) or [()] * 6
        numbers = lambda *names: pa.list_(pa.struct([(n, pa.int64()) for n in names]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), numbers("start", "words", "source"), numbers("start", "words"))
        t = pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_words", "n_removed", "kept_text", "factors", "spans"])
        return t.set_column(3, "kept_text", t.column("kept_text").cast(pa.string()))

    entries = texts.groupBy("block").applyInArrow(index, "bucket int, block long, ids binary, counts binary, keys binary")
    replies = entries.groupBy("bucket").applyInArrow(_first_owners, "block long, bucket int, at binary, ids binary, near binary")
    schema = "doc_id long, n_words long, n_removed long, kept_text string, factors array<struct<start: long, words: long, source: long>>, spans array<struct<start: long, words: long>>"
    return texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(parse, schema)


#: For tables in which a doc_id names one row.
SUBSTRING_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
pos AS (SELECT doc_id, words, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT doc_id, i, words[i:i + {WINDOW - 1}] AS phrase FROM pos WHERE i + {WINDOW - 1} <= len(words)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY phrase) < doc_id AS again FROM g),
c AS (
  SELECT doc_id, i, word, max(coalesce(again, false)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone
  FROM pos LEFT JOIN f USING (doc_id, i)
),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
