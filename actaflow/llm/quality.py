"""Quality rules by repetition coverage.

For several n-gram lengths the text's word hashes are rolled into window hashes
in numpy; windows found twice or more mark their words, and the share of word
characters inside marked words is the coverage at that length.  Lines equal to
an earlier line give a coverage of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from actaflow.llm.words import MULT, WORD_HASHES, WordHashes, mix

#: Share of word characters that duplicated n-grams of this many words may hold.
#: A short line or two said again stay below; a long passage pasted twice does not, for which
#: the limit at ten words is stricter.
NGRAM_LIMITS = {5: 0.30, 7: 0.28, 10: 0.15}
#: Share of word characters that repeated lines may hold.
LINE_LIMIT = 0.30
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_coverage double, " + ", ".join(f"coverage_{n} double" for n in NGRAM_LIMITS)
)


class RollingHashes:
    """Hashes of the windows of every length over one pass of a text.

    The words' hashes are summed up with growing powers of an odd multiplier; a
    window's hash is the difference of two such sums, brought back to power 0 by the
    multiplier's inverse, in wrapping 64-bit arithmetic."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * _powers(MULT, n), out=self.sums[1:])
        self.back = _powers(_INVERSE, n)

    def windows(self, n: int) -> np.ndarray:
        return mix((self.sums[n:] - self.sums[:-n]) * self.back[: len(self.sums) - n]) if len(self.sums) > n else np.empty(0, np.uint64)


_INVERSE = np.uint64(pow(int(MULT), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; kept for later texts."""
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        held = np.full(max(1024, 2 * n), base, np.uint64)
        held[0] = 1
        _POWERS[int(base)] = held = np.multiply.accumulate(held)
    return held[:n]


def _covered(rolling: RollingHashes, n: int, words: int) -> np.ndarray:
    """Which words lie in an n-word window found twice or more."""
    marks = np.zeros(words + 1, np.int32)
    w = rolling.windows(n)
    if len(w):
        _, inverse, counts = np.unique(w, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(counts[inverse] > 1)
        if len(starts):
            np.add.at(marks, starts, 1)
            np.add.at(marks, starts + n, -1)
    return np.cumsum(marks[:-1]) > 0


def _chars(word: bytes) -> int:
    return len(word) if word.isascii() else len(word.decode("utf-8"))


def measure(text: str | None, hashes: WordHashes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line coverage, coverage by length."""
    raw = (text or "").encode("utf-8")
    words = raw.split()
    lengths = np.fromiter(map(_chars, words), np.int64, len(words))
    chars = int(lengths.sum())
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    dup_lines = dup_chars = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup_lines += 1
            dup_chars += sum(map(_chars, line.split()))
        elif line.split(None, 1):
            seen.add(line)
    rolling = RollingHashes(hashes.of(words))
    repeat = int(_covered(rolling, 3, len(words)).sum())
    share = [float(lengths[_covered(rolling, n, len(words))].sum()) / chars if repeat else 0.0 for n in NGRAM_LIMITS]
    return len(words), chars, symbols, dup_lines, repeat, dup_chars / chars if chars else 0.0, share


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each input row; null and empty texts have no words and fail.

    Repeated rows are judged one by one, a null doc_id is passed through, an empty
    table gives no rows and other columns of the input are not read.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WORD_HASHES
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, chars, symbols, lines, repeat, line_share, share = measure(text.as_py(), hashes)
                failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
                kept = not failed and line_share <= LINE_LIMIT and all(x <= m for x, m in zip(share, NGRAM_LIMITS.values()))
                out.append((doc_id, n, chars, symbols, lines, repeat, failed, kept, line_share, *share))
            columns = list(zip(*out)) or [()] * (9 + len(NGRAM_LIMITS))
            kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * (1 + len(NGRAM_LIMITS))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_NAMES)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(judge, SCHEMA)


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _coverage_sql(name: str, n: int) -> str:
    """Words of every n-word window that its text has twice or more, as doc_id and i."""
    return f"""
{name}w AS (SELECT doc_id, i, words[i:i + {n - 1}] AS w FROM pos WHERE i + {n - 1} <= len(words)),
{name}f AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) > 1 AS again FROM {name}w),
{name}c AS (
  SELECT doc_id, word, max(coalesce(again, false)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS covered
  FROM pos LEFT JOIN {name}f USING (doc_id, i)
),
{name} AS (SELECT doc_id, count(*) FILTER (covered) AS n, coalesce(sum(length(word)) FILTER (covered), 0) AS chars FROM {name}c GROUP BY doc_id)"""


#: For tables in which a doc_id names one row.
QUALITY_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
ws AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
pos AS (SELECT doc_id, words, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM ws),
l AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS nth
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM t)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
d AS (SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars FROM l WHERE nth > 1 GROUP BY doc_id),
{','.join(_coverage_sql(f'c{n}', n) for n in (3, *NGRAM_LIMITS))},
b AS (
  SELECT ws.doc_id, len(words) AS n_words, length(list_aggregate(list_append(words, ''), 'string_agg', '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(d.n, 0) AS n_dup_lines, coalesce(c3.n, 0) AS n_repeat_words,
    len(words) < {MIN_WORDS} OR 100 * coalesce(c3.n, 0) > {MAX_REPEAT_PERCENT} * len(words) AS base_failed,
    coalesce(d.chars, 0)::DOUBLE AS line_chars, {', '.join(f'coalesce(c{n}.chars, 0)::DOUBLE AS chars_{n}' for n in NGRAM_LIMITS)}
  FROM ws LEFT JOIN d USING (doc_id) LEFT JOIN c3 USING (doc_id) {' '.join(f'LEFT JOIN c{n} USING (doc_id)' for n in NGRAM_LIMITS)}
),
s AS (
  SELECT *, CASE WHEN word_chars > 0 THEN line_chars / word_chars ELSE 0.0 END AS dup_line_coverage,
    {', '.join(f'CASE WHEN n_repeat_words > 0 THEN chars_{n} / word_chars ELSE 0.0 END AS coverage_{n}' for n in NGRAM_LIMITS)}
  FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND dup_line_coverage <= {LINE_LIMIT} AND {' AND '.join(f'coverage_{n} <= {m}' for n, m in NGRAM_LIMITS.items())} AS kept,
  dup_line_coverage::DOUBLE AS dup_line_coverage, {', '.join(f'coverage_{n}::DOUBLE AS coverage_{n}' for n in NGRAM_LIMITS)}
FROM s
"""
