"""Fill-in-the-middle by ropes.

A text is cut into units (white space with the word behind it).  Its rope is a balanced
tree whose leaves hold a stretch of the text and cache how many units and code points it
has; inner nodes cache the sums.  Splitting at two unit ranks walks two paths from the
root, and the three parts are joined in another order with sentinels in between: no text
is copied until the rope is written out.  The output is inverted the same way: the rope of
the output is split at the code points of its sentinels, and the parts are joined in the
first order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, how many are transformed, and of 100 transformed how many have the suffix first.
RATE, SPM_RATE, SEED = 50, 80, 42
#: Units in a leaf.
LEAF_UNITS = 512
#: Rows of an output batch; texts may be long.
_BATCH_CHARS = 8 << 20


class Rope(NamedTuple):
    """A leaf (``text`` is set) or an inner node; ``units`` and ``chars`` are of all below."""

    units: int
    chars: int
    text: str | None = None
    left: Rope | None = None
    right: Rope | None = None
    height: int = 0


EMPTY = Rope(0, 0, "")


def leaf(text: str, units: int) -> Rope:
    return Rope(units, len(text), text)


def join(a: Rope, b: Rope) -> Rope:
    """a before b.  The shorter one goes down the flank of the taller, so that heights stay
    within one of each other there and later splits stay short."""
    if not a.chars:
        return b
    if not b.chars:
        return a
    if a.height > b.height + 1:
        return _node(a.left, join(a.right, b))
    if b.height > a.height + 1:
        return _node(join(a, b.left), b.right)
    return _node(a, b)


def _node(a: Rope, b: Rope) -> Rope:
    if a.height > b.height + 1 and a.right is not None:
        if a.right.height > a.left.height and a.right.left is not None:
            return _inner(_inner(a.left, a.right.left), _inner(a.right.right, b))
        return _inner(a.left, _inner(a.right, b))
    if b.height > a.height + 1 and b.left is not None:
        if b.left.height > b.right.height and b.left.left is not None:
            return _inner(_inner(a, b.left.left), _inner(b.left.right, b.right))
        return _inner(_inner(a, b.left), b.right)
    return _inner(a, b)


def _inner(a: Rope, b: Rope) -> Rope:
    return Rope(a.units + b.units, a.chars + b.chars, None, a, b, 1 + max(a.height, b.height))


def _balanced(leaves: list[Rope]) -> Rope:
    while len(leaves) > 1:
        leaves = [_inner(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else EMPTY


def rope_of(text: str) -> Rope:
    """The rope of a text, in leaves of LEAF_UNITS units."""
    leaves, begin, count, end = [], 0, 0, 0
    for unit in UNIT.finditer(text):
        end, count = unit.end(), count + 1
        if count == LEAF_UNITS:
            leaves.append(leaf(text[begin:end], count))
            begin, count = end, 0
    if count:
        leaves.append(leaf(text[begin:], count))
    return _balanced(leaves)


def rope_of_chars(text: str, size: int = 4096) -> Rope:
    """The rope of a text that is split by code points alone; its units are its code points."""
    return _balanced([leaf(text[i : i + size], len(text[i : i + size])) for i in range(0, len(text), size)])


def split(rope: Rope, units: int) -> tuple[Rope, Rope]:
    """The first ``units`` units, and the rest."""
    if units <= 0:
        return EMPTY, rope
    if units >= rope.units:
        return rope, EMPTY
    if rope.text is not None:
        if rope.units == rope.chars:  # units of one code point each
            at = units
        else:
            at = next(m.end() for k, m in enumerate(UNIT.finditer(rope.text), 1) if k == units)
        return leaf(rope.text[:at], units), leaf(rope.text[at:], rope.units - units)
    if units < rope.left.units:
        a, b = split(rope.left, units)
        return a, join(b, rope.right)
    a, b = split(rope.right, units - rope.left.units)
    return join(rope.left, a), b


def write(rope: Rope) -> str:
    """The text of a rope, leaf by leaf."""
    out, open_nodes = [], [rope]
    while open_nodes:
        node = open_nodes.pop()
        if node.text is not None:
            out.append(node.text)
        else:
            open_nodes += (node.right, node.left)
    return "".join(out)


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, ...]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def transform(text: str | None, doc_id: int | None, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, str]:
    """n, form, code points of prefix and of middle, output."""
    text, (h1, h2, h3, h4) = text or "", draws(doc_id, seed)
    rope = rope_of(text)
    n = rope.units
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, rest = split(rope, first)
    middle, suffix = split(rest, second - first)
    if h4 % 100 < spm_rate:
        form, parts = "spm", (leaf(SUFFIX, 1), suffix, leaf(PREFIX, 1), prefix, leaf(MIDDLE, 1), middle)
    else:
        form, parts = "psm", (leaf(PREFIX, 1), prefix, leaf(SUFFIX, 1), suffix, leaf(MIDDLE, 1), middle)
    out = EMPTY
    for part in parts:
        out = join(out, part)
    return n, form, prefix.chars, middle.chars, write(out)


def restore(output: str | None, form: str | None) -> str:
    """The text that ``transform`` made ``output`` of; ValueError if it can't have."""
    output = output or ""
    if form == "plain":
        return output
    marks = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}.get(form)
    if marks is None:
        raise ValueError(f"unknown form {form!r}")
    at = [output.find(mark) for mark in marks]
    if at[0] != 0 or not at[0] < at[1] < at[2]:
        raise ValueError(f"no {form} output: its sentinels are at {at}")
    parts, rest, done = [], rope_of_chars(output), 0
    for mark, end in zip(marks, (*at[1:], len(output))):
        _, rest = split(rest, len(mark))
        part, rest = split(rest, end - done - len(mark))
        parts.append(part)
        done = end
    a, b, middle = parts
    prefix, suffix = (a, b) if form == "psm" else (b, a)
    return write(join(join(prefix, middle), suffix))


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _batches(rows: Iterator[tuple], names: list[str], kinds: tuple[pa.DataType, ...], text_at: int) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, each of a bounded number of code points (but one row at least)."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[text_at] or "") + 64
        if chars >= _BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row for each input row.

    A null or empty text is the empty text, form plain.  A null doc_id draws as the empty
    string; repeated rows, and different texts of one doc_id, are transformed one by one with
    the same draws.  An empty table gives no rows; other columns, whatever their names, are not
    read.  A text is handled as a whole, and its output is longer by nine code points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((doc_id, *transform(text.as_py(), doc_id, seed, rate, spm_rate)) for batch in batches for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)))
        return _batches(rows, _NAMES, _KINDS, 5)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def restore_texts(outputs: DataFrame) -> DataFrame:
    """The rows of ``outputs`` (those of ``fill_in_middle``) with the text that each is made
    of as ``restored``.  An output that lacks a sentinel of its form ends the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((*row.values(), restore(row["output"], row["form"])) for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist())
        return _batches(rows, [*_NAMES, "restored"], (*_KINDS, pa.string()), 6)

    return outputs.select(*_NAMES).mapInArrow(run, f"{SCHEMA}, restored string")


#: For tables in which a doc_id names one row.
FIM_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
),
d AS (
  SELECT doc_id, text, units, len(units) AS n,
    ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS r1, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS r2,
    ('0x' || h[17:24])::BIGINT % 100 AS r3, ('0x' || h[25:32])::BIGINT % 100 AS r4
  FROM t
),
f AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR r3 >= {RATE} THEN 'plain'
    WHEN r4 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(units[1:least(r1, r2)], '') AS prefix, array_to_string(units[least(r1, r2) + 1:greatest(r1, r2)], '') AS middle,
    array_to_string(units[greatest(r1, r2) + 1:], '') AS suffix
  FROM d
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
    ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM f
"""
