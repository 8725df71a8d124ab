"""Decontamination against a brute-force version that compares windows word by word."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
import regex

from actaflow.llm import decontam

_B = r"[ \t\n\x0B\f\r]"
_NUM = r"\p{N}(?:[\p{N}.,]*\p{N})?"
_UNIT = regex.compile(rf"(?<![\p{{L}}\p{{N}}\x01])({_NUM}){_B}*((?i:{'|'.join(decontam.UNITS)}))(?![\p{{L}}\p{{N}}])")
_NUMBER = regex.compile(rf"(?<![\p{{L}}\p{{N}}\x01.,])({_NUM})(?![\p{{L}}\p{{N}}])")
_INNER_NAME = regex.compile(rf"(?<=[\p{{Ll}}\p{{N}},;]{_B})(\p{{Lu}}\p{{L}}*)(?![\p{{L}}\p{{N}}])")
_ANY_NAME = regex.compile(r"(?<![\p{L}\p{N}\x01])(\p{Lu}\p{L}*)(?![\p{L}\p{N}])")
_JOINED = regex.compile(r"[ \t-]\x01p(?<=\x01p\p{L}+[ \t-]\x01p)|\. \x01p(?<=\x01p(?:\p{Lu}|Mrs?|Ms|Dr|Prof|St)\. \x01p)")
_WORD = regex.compile(r"\p{L}+")
_ONES = set("one two three four five six seven eight nine".split())
_SCALES = set("hundred thousand million billion dozen".split())


def one_number(text):
    """Numbers of several words as one."""
    out, at, before, end = [], 0, None, -1
    for m in _WORD.finditer(text):
        word, start = m[0].lower(), m.start()
        if word in decontam.NUMBER_WORDS:
            between = text[end:start] if before else None
            tens = before and before.endswith("ty") and (word in _ONES or word in "first third fourth fifth sixth seventh eighth ninth".split())
            if between in (" ", "-") and (tens or word in _SCALES) or (before in _SCALES and between in (" ", "-", " and ", " and-")):
                out.append(text[at:end] + "\x02")
                at = start
            before, end = word, m.end()
    return "".join(out) + text[at:]


def number_word(w):
    bare = w.removeprefix("\x01p")
    return "\x01n" + bare if bare in decontam.NUMBER_WORDS or ("\x02" in w and w[0] != "\x01") else w


_APART = regex.compile(r"(?:[^\p{L}\p{N}\x01\x02.,]|[.,](?!\p{N})|(?<!\p{N})[.,])+")


def forms_of(text):
    """The narrow form and, where it differs, the wide one."""
    if text is None:
        return []
    text = one_number(_NUMBER.sub("\x20\x01n\\1 ", _UNIT.sub(" \x01n\\1 \x01u\\2 ", text)))
    named = _INNER_NAME.sub("\x01p\\1", text), _JOINED.sub("\x02", _ANY_NAME.sub("\x01p\\1", text))
    forms = [[number_word(w) for w in _APART.split(x.lower()) if w] for x in named]
    wide = forms[1]
    forms[1] = ["\x01u" + w if i and wide[i - 1].startswith("\x01n") and w[0] != "\x01" else w for i, w in enumerate(wide)]
    return [] if not forms[0] else forms[:1] if forms[0] == forms[1] else forms


def typed(words):
    return tuple(w[:2] if w[0] == "\x01" else w for w in words)


def plain(words):
    return tuple(w[2:] if w[0] == "\x01" else w for w in words)


def spelled(filler):
    if not filler.startswith("\x01u"):
        return filler
    one = filler[2:].removesuffix("s") or "s"
    return "\x01u" + (decontam.SPELLINGS.get(filler[2:], decontam.SPELLINGS.get(one, one)).removesuffix("s") or "s")


def consistent(pairs):
    pairs = set(pairs)
    names = {p for p in pairs if p[0].startswith("\x01p")}
    return len({a for a, _ in pairs}) == len(pairs) and len({b for _, b in names}) == len(names)


def literals(words):
    return sum(w[0] != "\x01" for w in words)


def brute(docs, items, window=10):
    """(doc_id, contaminated, n_items, item_id) of every row."""
    index, forms = defaultdict(list), {}
    for at, (_, text) in enumerate(items):
        forms[at] = forms_of(text)
        for wide, words in enumerate(forms[at]):
            size = min(window, len(words))
            for i in range(len(words) - size + 1):
                w = words[i : i + size]
                keys = ({typed(w)} if literals(w) >= 2 else set()) | (set() if wide else {plain(w)})
                for key in keys:
                    index[key].append((at, wide, len(words) - size + 1, i, w))
    sizes = {len(k) for k in index}
    out = []
    for doc_id, text in docs:
        runs = defaultdict(dict)
        for wide, words in enumerate(forms_of(text)):
            for size in sizes:
                for j in range(len(words) - size + 1):
                    d = words[j : j + size]
                    for key in {typed(d)} | (set() if wide else {plain(d)}):
                        for at, item_wide, n, i, w in index.get(key, ()):
                            same = plain(d) == plain(w)
                            pairs = list(zip(map(spelled, (x for x in w if x[0] == "\x01")), map(spelled, (x for x in d if x[0] == "\x01"))))
                            literal = size - sum(a != b for a, b in pairs)
                            fits = typed(d) == typed(w) and literals(w) >= 2 and consistent(pairs) and 2 * literal >= size
                            if (size == 1 and len(words) > 1) or not (same or fits):
                                continue
                            k = (at, wide, item_wide, j - i)
                            first, last = i == 0 and w[0].startswith("\x01p"), i == n - 1 and w[-1].startswith("\x01p")
                            if len([x for x in w if x[0] == "\x01"]) == len([x for x in d if x[0] == "\x01"]):
                                inner = pairs[int(first) : len(pairs) - int(last)]
                            else:
                                inner = []
                            runs[k].setdefault("all", set()).add(i)
                            runs[k].setdefault("plain", set()).update({i} if same else ())
                            runs[k].setdefault("pairs", set()).update(inner)
                            runs[k]["n"] = n
        hit = {k[0] for k, r in runs.items() if r["plain"] or (consistent(r["pairs"]) and 2 * len(r["all"]) >= r["n"])}
        out.append((doc_id, bool(hit), len(hit), min((items[at][0] for at in hit if items[at][0] is not None), default=None)))
    return sorted(out, key=str)


def judged(spark, docs, items, **limits):
    found = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **limits)
    return sorted(map(tuple, found.collect()), key=str)


def reworded(rng, text):
    """The item with other numbers and other names, the same one for the same one."""
    seen = {}
    text = regex.sub(r"\d+", lambda m: seen.setdefault(m[0], str(rng.randrange(2, 99))), text)
    return regex.sub(r"(?<=[a-z,] )[A-Z][a-z]+", lambda m: seen.setdefault(m[0], rng.choice(["Uma", "Ivo", "Lea", "Bo"])), text)


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    """The smallest tables, with re-parameterised and short items planted among them."""
    rng = random.Random(12)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    made = [
        "Tom bought 3 kg of apples and 12 pears while Anna sold 3 boxes of the other kind to Tom before 4 pm",
        "What is 17 plus 25 times 3 minus 4",
        "A farm has 16 ducks. Janet eats three for breakfast and sells the rest at 2 dollars to Maria Baker.",
        "Add 17 to 25", "A jar holds twenty five beans and three hundred and six peas; Sam takes out one and a dozen more. How many of one kind are in two jars?",
        "Capital of France quickly", "Who wrote Don Quixote?", "Quixote", "17 plus 25", "...", None, "Capital of France quickly",
    ]
    items += [(1000 + k, t) for k, t in enumerate(made)]
    for k, text in enumerate(t for t in made if t):
        some = docs[3 * k][1] or ""
        docs += [(5000 + k, f"{some[:200]} {text} {some[200:300]}"), (6000 + k, reworded(rng, text)), (None, f"x. {reworded(rng, text)} y"), (7, text.upper())]
    return docs, items


def test_every_row_against_brute_force(spark, rows):
    docs, items = rows
    want = brute(docs, items)
    assert judged(spark, docs, items) == want and 20 < sum(r[1] for r in want) < len(want)


def test_other_plans_give_the_same_rows(spark, rows):
    """On the far side of every limit."""
    docs, items = rows
    limits = {"max_broadcast": 0, "max_vocabulary": 3, "max_filter_bits": 64}
    assert judged(spark, docs[-60:], items[-15:], **limits) == brute(docs[-60:], items[-15:])


def test_rows_of_one_doc_id_are_judged_each_by_its_text(spark):
    item = "one day {} gave the old book to {} who had read all of it before noon and {} was glad about it"
    halves = item.format("Tom", "Anna", "Tom").split()
    docs = [(5, item.format("Eva", "Maria", "Eva")), (5, item.format("Ed", "Mary", "Ed")), (None, item.format("Ed", "Lia", "Ed")), (None, item.format("Eva", "Lia", "Eva"))]
    docs += [(9, " ".join(halves[:8])), (9, " ".join(halves[8:16])), (9, None), (None, "")]
    got = judged(spark, docs, [(1, item.format("Tom", "Anna", "Tom"))])
    assert sum(r[1] for r in got) == 4 and {r[0] for r in got if r[1]} == {5, None}


def test_short_numeric_and_four_word_items(spark):
    items = [(1, "What is 17 plus 25 times 3 minus 4"), (2, "Capital of France quickly"), (3, "Quixote")]
    docs = [(1, "so, what is 18 plus 26 times 5 minus 6?"), (2, "name the capital of france, quickly!"), (3, "Quixote"), (4, "Quixote rides"), (5, "capital of spain quickly")]
    assert [r[3] for r in judged(spark, docs, items)] == [1, 2, 3, None, None]
    sums = [(1, "Add 17 to 25"), (2, "17 25 30 41"), (3, "Who wrote Quixote?")]
    docs = [(1, "then add 18 to 26, please"), (2, "1 2 3 4 5 6 7 8"), (3, "and who wrote Hamlet then"), (4, "Add Tom to 25"), (5, "18 17 25 30 41")]
    assert [(r[0], r[3]) for r in judged(spark, docs, sums)] == [(1, 1), (2, None), (3, 3), (4, None), (5, 2)]


def test_numbers_in_words_any_unit_and_long_names(spark):
    said = "Sam has {} apples and buys {} more then eats {} of them and gives {} to Tom so how many are left"
    field = "A field is {} {} wide and {} {} long and {} {} deep so how many 2 {} plots fit"
    name = "the letter that came from {} in the last week was lost"
    items = [(1, said.format("three", "five", "two", "four")), (2, field.format(12, "furlongs", 9, "chains", 30, "rods", "acre")), (3, name.format("Anna Baker"))]
    docs = [
        (1, said.format("seven", "nine", "one", "six")), (2, said.format("twenty-five", "three hundred and twelve", "Forty", "two dozen")), (3, said.format("many", "some", "a few", "none")),
        (4, field.format(14, "leagues", 8, "links", 20, "ells", "hectare")), (5, field.format("fourteen", "leagues", "eight", "links", "twenty two", "ells", "hectare")),
        (6, name.format("Maximilian" + "a" * 60 + " Alexander Smith")), (7, name.format("nobody at all")), (8, said.format("3", "5 thousand", "2", "4")),
    ]
    got = judged(spark, docs, items)
    assert {r[0]: r[3] for r in got} == {1: 1, 2: 1, 3: None, 4: 2, 5: 2, 6: 3, 7: None, 8: 1}
    assert got == brute(docs, items)


def test_equal_items_and_copies_don_t_multiply(spark):
    item = "a question of some length that is asked again and again in every list of questions"
    bench = spark.createDataFrame([(i, item) for i in range(300)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x {item} y") for i in range(300)] + [(900, "clean")], "doc_id long, text string")
    assert decontam.matches(docs, bench).count() == 1
    got = decontam.decontaminate(docs, bench).collect()
    assert len(got) == 301 and all((r.contaminated, r.n_items, r.item_id) == (r.doc_id < 900, 300 * (r.doc_id < 900), 0 if r.doc_id < 900 else None) for r in got)


def test_odd_tables(spark):
    schema = "doc_id long, text string, item_id long, wide int, words string"
    item = "these are the ten words that a window has here"
    odd = [(1, None, 1, 1, "a"), (2, "", 1, 1, "a"), (3, "?!", 1, 1, "a"), (4, f"{'w ' * 200_000}{item}", 1, 1, "a"), (None, item, 1, 1, "a"), (4, "again", 1, 1, "a")]
    docs = spark.createDataFrame(odd, schema)
    bench = spark.createDataFrame([(7, item, 1), (None, None, 1)], "item_id long, text string, doc_id int")
    got = sorted(map(tuple, decontam.decontaminate(docs, bench).collect()), key=str)
    assert got == sorted([(1, False, 0, None), (2, False, 0, None), (3, False, 0, None), (4, True, 1, 7), (4, False, 0, None), (None, True, 1, 7)], key=str)
    nothing = spark.createDataFrame([(1, None), (2, " . ")], "item_id long, text string")
    assert decontam.decontaminate(docs, nothing).filter("contaminated").count() == 0
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0
    assert len(decontam.clean_rows(docs, bench).collect()) == 4 and decontam.clean_rows(docs, bench).columns == docs.columns
    long_number = "9" * 1_200_000
    million = [(1, f"the sum of all that they paid was {long_number} in the end")]
    assert [r[1] for r in judged(spark, [(1, million[0][1]), (2, million[0][1].replace("9 in", "8 in").replace("sum", "total"))], million)] == [True, False]
