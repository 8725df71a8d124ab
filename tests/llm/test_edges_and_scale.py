"""Odd tables, hot groups and the far side of every size at which a plan changes."""

from __future__ import annotations

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from actaflow.llm import chat, jaccard, langid, lines, mixing, quality, urls
from actaflow.llm.words import WordHashes
from tests.llm.test_training_data import brute_components, prose


def test_url_of_many_labels_and_repeated_rows(spark):
    rows = [(1, "http://" + "a." * 20_000 + "com/en/1"), (2, "https://x.example.com/en/7/a?q"), (2, "https://x.example.com/en/7/a?q"), (None, None)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, host string, keys int")
    got = urls.url_filter(pages, spark.sql(urls.RULES_SQL)).collect()
    assert sorted((str(r.page_id), str(r.rule), r.verdict) for r in got) == [("1", "com/en/", "block"), ("2", "example.com/en/7", "allow"), ("2", "example.com/en/7", "allow"), ("None", "None", "allow")]


def test_url_rules_in_shards(spark):
    ids = spark.range(900)
    tld = F.when(F.col("id") % 3 == 0, ".com").otherwise(".co.uk")
    host = F.concat(F.lit("h"), F.col("id").cast("string"), tld)
    rules = ids.filter("id < 300").select(F.when(F.col("id") % 2 == 0, "block").otherwise("allow").alias("action"), host.alias("host"), F.lit("/p").alias("path"))
    rules = rules.unionByName(spark.createDataFrame([("block", None, "/")], "action string, host string, path string"))
    pages = ids.select(F.col("id").alias("page_id"), F.concat(F.lit("http://www."), host, F.lit("/pa")).alias("url"))
    got = urls.url_filter(pages, rules, shard_keys=40).collect()
    assert {r.page_id: r.verdict for r in got if r.rule} == {i: "block" if i % 2 == 0 else "allow" for i in range(300)}
    assert len(got) == 900


def test_mixing_with_a_source_for_every_document(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id")).alias("source"), F.expr("repeat('w ', cast(1 + id % 7 as int))").alias("text"))
    got = mixing.mix_sources(docs, block_rows=100, max_broadcast=0).collect()
    assert len(got) == 6000 and all(abs(r.taken - r.target) < r["size"] + 1e-6 and r.taken <= 2 * r["size"] for r in got)


def test_mixing_levels_are_of_bounded_blocks(spark, monkeypatch):
    """However many sources there are, no block of any level holds many rows."""
    most = []
    level = mixing._level

    def watched(rows, seed, at, last, keys):
        most.append(rows.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return level(rows, seed, at, last, keys)

    monkeypatch.setattr(mixing, "_level", watched)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 2000).alias("source"), F.expr("repeat('w ', cast(1 + id % 7 as int))").alias("text"))
    mixing.mix_sources(docs, block_rows=100).count()
    assert len(most) > 1 and max(most) <= 200


def test_mixing_of_equal_and_odd_rows(spark):
    schema = "doc_id long, text string, source string, block int, nth int, p double"
    rows = [(None, "one two three", "a" if i % 3 == 0 else "b", 1, 1, 0.5) for i in range(3000)] + [(1, None, None, 1, 1, 0.5), (2, "", "a", 1, 1, 0.5), (3, "w " * 100_000, None, 1, 1, 0.5)]
    got = mixing.mix_sources(spark.createDataFrame(rows, schema), block_rows=200).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[2]) for r in rows)
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= (100_000 if s is None else 3) for s in target)
    assert mixing.mix_sources(spark.createDataFrame([], schema)).count() == 0


def test_pivotal_rounding_keeps_expectations():
    """Over many seeds a document's copies come to its probability."""
    import pyarrow as pa

    rows = [{"doc_id": i, "source": "a", "size": 1 + i % 3, "digest": i, "p": 0.3, "settled": False} for i in range(12)]
    total = np.zeros(12)
    for seed in range(600):
        total += [r["p"] for r in sorted(mixing._settle(pa.Table.from_pylist(rows), seed, 0, True).to_pylist(), key=lambda r: r["doc_id"])]
    assert np.abs(total / 600 - 0.3).max() < 0.08


def test_chat_parts_of_equal_turns(spark):
    """Turns that are equal in every respect are cut, too; a null conversation is one."""
    rows = [(None, 1, "user", "same", 1)] * 900 + [(1, None, None, None, 1), (1, None, "user", "x" * 200_000, 1), (1, 0, "assistant", "b", 1), (1, 0, "assistant", "a", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    strip = lambda out: sorted((str(r.conv_id), r.turn or -1, r.new_role, r.action, r.n_inserted, r.piece) for r in out)
    whole, cut, shuffled = (chat.format_chats(turns, **k).collect() for k in ({}, {"part_rows": 100}, {"part_rows": 100, "max_broadcast": 0}))
    assert strip(whole) == strip(cut) == strip(shuffled) and len(whole) == len(rows)
    text = "".join(r.piece for r in sorted((r for r in cut if r.conv_id is None), key=lambda r: r.nth))
    assert text == "<|im_start|>user\n" + "\n".join(["same"] * 900) + "<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"


def letters(i):
    return "".join(chr(97 + (i // 26**k) % 26) for k in range(3))


def test_more_languages_than_a_block(spark, monkeypatch):
    """Seventy languages, each from its share of a small sample, in blocks of sixteen."""
    monkeypatch.setattr(langid, "LANG_BLOCK", 16)
    rows = [(i, " ".join(letters(97 * (i % 70) + j) * 2 for j in range(10)), f"L{i % 70:02d}") for i in range(1400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [r for r in langid.identify_languages(docs).collect() if r.held_out]
    assert sum(r.lang_pred == f"L{r.doc_id % 70:02d}" for r in got) >= 0.95 * len(got)


def test_ridge_regression_against_a_direct_solve():
    rng = random.Random(4)
    langs = sorted(f"l{i % 3}" for i in range(90))
    texts = [" ".join(rng.choice(["alpha beta", "gamma delta", "epsilon zeta"][int(x[1])].split()) + rng.choice("xyz") for _ in range(9)) for x in langs]
    bits = np.packbits(langid.presence(texts).astype(bool), axis=1)
    model = langid.fit(langs, bits)
    dense = langid.normalise(langid.presence(texts)).astype(np.float64)
    marks = langid.normalise(np.unpackbits(model.landmarks, axis=1, count=langid.SLOTS).astype(np.float32)).astype(np.float64)
    assert len(marks) == 3 * langid.LANDMARKS_PER_LANG
    values, vectors = np.linalg.eigh(marks @ marks.T)
    keep = values > 1e-6 * values.max()
    phi = np.hstack([dense @ marks.T @ (vectors[:, keep] / np.sqrt(values[keep])), np.ones((len(texts), 1))])
    target = np.where(np.array(langs)[:, None] == np.array(model.langs), 1.0, -1.0)
    direct = phi @ np.linalg.solve(phi.T @ phi + langid.RIDGE * np.eye(phi.shape[1]), phi.T @ target)
    assert np.abs(model.scorer()(langid.presence(texts))[0] - direct).max() < 1e-2


def test_rolling_sums_tell_windows_apart():
    rng = random.Random(1)
    words = [rng.choice("ab") for _ in range(300)]
    rolling = quality.RollingHashes(WordHashes().of([w.encode() for w in words]))
    for n in (1, 3, 10, 300, 301):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        w = rolling.windows(n).tolist()
        assert len(w) == len(grams) and len(set(w)) == len(set(grams)) == len(set(zip(w, grams)))


def test_a_long_passage_pasted_twice_is_a_fault(spark):
    rng = random.Random(5)
    passage, rest = prose(rng, 45, 9999), prose(rng, 310, 99999)
    docs = spark.createDataFrame([(1, f"{passage} {rest} {passage}"), (2, f"{rest} {passage}"), (3, f"{rest} a short line {rest[:0]} a short line")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality.quality_rules(docs).collect()} == {1: False, 2: True, 3: True}
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_line_dedup_of_odd_tables(spark):
    schema = "doc_id long, text string, source string, _gone int, _doc string, c0 int, h string"
    note = "on ten sites"
    rows = [(i, f"line {i}\n{note}", f"s{i}", 1, "a", 2, "b") for i in range(12)] + [(3, f"line 3\n{note}", "s3", 1, "a", 2, "b"), (50, note + "\n" + "x" * 500_000, None, 1, "a", 2, "b")]
    docs = spark.createDataFrame(rows, schema)
    got, far = lines.dedup_lines(docs), lines.dedup_lines(docs, max_broadcast=0)
    assert got.columns[:7] == docs.columns and sorted(map(str, got.collect())) == sorted(map(str, far.collect()))
    assert {(r.doc_id, note in r.text, r._n_removed) for r in got.collect()} == {(0, True, 0)} | {(i, False, 1) for i in (*range(1, 12), 50)}
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_is_linear_in_a_text(spark):
    """A dozen texts of 200,000 lines, all but one of which go; the square of that would not end."""
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda i: F.concat(F.lit("note "), i)), "\n")
    ids = spark.range(13, numPartitions=4).withColumn("source", F.concat(F.lit("s"), F.col("id")))
    docs = ids.select(F.when(F.col("id") < 12, F.col("id")).alias("doc_id"), "source", F.concat(body, F.lit("\nmine "), "source").alias("text"))
    start = time.monotonic()
    got = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert time.monotonic() - start < 120
    assert got[0]._n_removed == 0 and all(got[i].text == f"mine s{i}" for i in range(1, 12)) and got[None].text == "mine s12"
    assert {r._n_lines for r in got.values()} == {200_001}


def test_line_dedup_of_rows_without_an_id(spark):
    """Rows without an id lose lines by their own texts; columns named like the counts are replaced."""
    rows = [(i if i < 10 else None, f"all sites\nline {i % 700}\nall sites", f"s{i % 20}", -1) for i in range(3000)] + [(None, None, "s1", -1), (None, "", "s1", -1)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string, _n_removed long"))
    assert got.columns == ["doc_id", "text", "source", "_n_lines", "_n_removed"]
    assert Counter((r.doc_id == 0, r._n_lines, r._n_removed, r.text is None) for r in got.collect()) == {(True, 3, 0, False): 1, (False, 3, 2, False): 2999, (False, 0, 0, True): 1, (False, 1, 0, False): 1}


def test_jaccard_of_many_rows_without_an_id(spark):
    """Rows without an id are dealt by their texts and linked like any other."""
    rng = random.Random(9)
    texts = [prose(rng, 40, 9999) for _ in range(300)]
    rows = [(None, t) for t in texts] + [(7, texts[0] + " end"), (None, texts[1] + " end"), (8, texts[2])]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=4000).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter({(None, None): 299, (7, 7): 1, (None, 7): 1, (8, 8): 1, (None, 8): 1})
    schema = "doc_id long, text string, key string, n int"
    docs = spark.createDataFrame([(*r, "k", 1) for r in [*rows, (8, texts[2]), (9, None), (9, None), (None, "")]], schema)
    kept = jaccard.one_of_each(docs, block_bytes=4000)
    assert kept.columns == docs.columns
    left = Counter((r.doc_id, r.text) for r in kept.collect())
    want = Counter((None, t) for t in texts[3:]) + Counter({(7, texts[0] + " end"): 1, (8, texts[2]): 1, (9, None): 2, (None, ""): 1})
    one = [k for k in left if k[1] in (texts[1], texts[1] + " end")]
    assert len(one) == 1 and left == want + Counter(one)


def test_jaccard_family_just_below_the_threshold(spark):
    """Hundreds of texts at a similarity of 0.70, all sharing their rarest tokens."""
    rng = random.Random(2)
    base = prose(rng, 200, 99999).split()
    docs = []
    for i in range(400):
        words = base[:145] + prose(rng, 25, 99999).split()
        docs.append((i, " ".join(words)))
    got = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(docs)


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def test_pipeline_stages_on_odd_tables(spark, pipeline, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, label string, component int"
    rng = random.Random(3)
    item = prose(rng, 20, 9999)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, f"the cat and the dog of house {prose(rng, 20)} number {i}" if i % 2 else f"der hund und die katze im haus {prose(rng, 20)} nummer {i}", "en" if i % 2 else "de", f"s{i % 4}", 9, "x", 1) for i in range(60)]
    rows += [(None, None, None, None, None, "x", 1), (70, "", "en", "s", 0, "x", 1), (71, "12 34 !!", None, "s", 8, "x", 1), (3, rows[3][1], "en", "s3", 9, "x", 1), (None, rows[5][1], None, None, 9, "x", 1)]
    rows += [(72, "日本語の文章はここで知られていない言語です、だから消える", None, "s", 9, "x", 1), (73, f"the dog {item} and the cat", "en", "s1", 9, "x", 1)]
    docs = spark.createDataFrame(rows, schema)
    kept = {}
    for name, stage in pipeline.STAGES:
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0
        docs = stage(spark, docs, str(tmp_path))
        if name != "source_mix":
            assert docs.columns == list(pipeline.COLUMNS)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = Counter(r.doc_id for r in docs.collect())
    assert kept["language_id"] == Counter([*range(60), 3, None, 73])
    assert kept["jaccard_join"] == Counter([*range(60), 73]) and kept["decontamination"] == Counter(range(60))
    assert kept["source_mix"] == kept["decontamination"]
    unlabelled = spark.createDataFrame([(i, f"some words {i}", None, "s", 9) for i in range(50)], "doc_id long, text string, lang string, source string, n_chars long")
    assert pipeline.language_id(spark, unlabelled, str(tmp_path)).count() == 50
