"""Fill-in-the-middle: ropes against strings, forms, odd tables."""

from __future__ import annotations

import hashlib
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from actaflow.llm import fim

TEXTS = st.text(alphabet="ab é\t\n\x1f <>PSM漢😀", max_size=60)


def naive(text, doc_id):
    """The contract over plain strings."""
    text = text or ""
    units = fim.UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.integers(0, 10**12))
def test_transform_is_the_contract_and_is_undone(text, doc_id):
    found = fim.transform(text, doc_id)
    assert found == naive(text, doc_id)
    assert fim.restore(found[4], found[1]) == text


def _check(rope):
    """Cached counts and heights of every node; the tree is balanced."""
    if rope.text is not None:
        assert rope.chars == len(rope.text) and rope.height == 0
        return
    _check(rope.left), _check(rope.right)
    assert (rope.units, rope.chars) == (rope.left.units + rope.right.units, rope.left.chars + rope.right.chars)
    assert rope.height == 1 + max(rope.left.height, rope.right.height)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3000), st.integers(0, 3000)), min_size=1, max_size=12))
def test_many_splits_and_joins_keep_counts_and_stay_low(cuts):
    text = " ".join(f"w{i}" for i in range(3000))
    units, rope = fim.UNIT.findall(text), fim.rope_of(text)
    for a, b in cuts:
        a, b = min(a, b), max(a, b)
        first, rest = fim.split(rope, a)
        middle, last = fim.split(rest, b - a)
        rope = fim.join(fim.join(last, first), middle)
        units = units[b:] + units[:a] + units[a:b]
        _check(rope)
        assert fim.write(rope) == "".join(units)
    assert rope.height <= 14


def test_a_split_looks_at_two_leaves_only():
    rope = fim.rope_of("word " * 400_000)
    start = time.time()
    for k in range(0, 400_000, 4001):
        a, b = fim.split(rope, k)
        assert a.units == k and b.units == rope.units - k
    assert time.time() - start < 5  # each split reads one leaf of the 782


def test_restore_refuses_what_no_transform_makes():
    for output, form in (("<S>a<P>b", "spm"), ("a<P>b<S>c<M>d", "psm"), ("<P>b<M>c<S>d", "psm"), ("x", "other")):
        with pytest.raises(ValueError):
            fim.restore(output, form)


def test_odd_tables(spark):
    long = "много слов " * 60_000
    rows = [(None, "a b c", "x"), (1, None, None), (2, "", "y"), (3, "<P> is a mark", "y"), (4, long, "y"), (4, long, "y"), (4, "other", "y"), (5, " \t\n", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string")
    found = fim.restore_texts(fim.fill_in_middle(docs)).collect()
    assert sorted(((r.doc_id, r.restored) for r in found), key=str) == sorted(((i, t or "") for i, t, _ in rows), key=str)
    for r in found:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == naive(r.restored, r.doc_id)
    assert fim.restore_texts(fim.fill_in_middle(docs.limit(0))).collect() == []
    assert {r.form for r in fim.fill_in_middle(docs, rate=100, spm_rate=0).collect() if r.doc_id in (4, 5)} == {"psm"}


def test_forms_come_at_their_rates(spark, sf_dir):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('some words of text ', id) as text")
    forms = {r.form: r["count"] for r in fim.fill_in_middle(docs).groupBy("form").count().collect()}
    assert abs(forms["plain"] - 2000) < 150 and abs(forms["spm"] - 1600) < 150 and abs(forms["psm"] - 400) < 90
