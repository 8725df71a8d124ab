"""Benchmark decontamination by template canonicalisation, in DataFrame functions.

Numbers in figures and in (English) words, units after numbers and capitalised words
inside a sentence become typed placeholders; everything else is lower-cased and loses
its punctuation.  In a second, wide form every capitalised word is a placeholder, at
the start of a sentence, too, and a run of them is one, so that names of any length
stand anywhere, and any word right after a number is a unit.  Windows of
``window`` words are hashed and joined with the windows of the benchmark (an item
shorter than a window is one window), either form with either.  Two windows with
the same template match as they are if their fillers are equal, and as a
re-parameterised question if their fillers are consistent: equal fillers of the
item stand against equal fillers of the document, and different names against
different names (different numbers may happen to be equal); units are equal in any
spelling.  Letter case and punctuation never matter, as windows that hold a
placeholder are looked up in their plain form, too.

A document is contaminated by an item if a plain window matches, or if at one
place consistent windows make up at least half of the item's and their fillers
agree as a whole.  A window with fewer than MIN_LITERALS words outside its slots has
no template; it matches where it stands word by word, and an item of one word only
a text that has no other.

The verdict is one on a text, so texts are told apart by their digest and not by
doc_id; items of the same words are one item while windows are joined.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actaflow.llm.store import checkpoint

WINDOW = 10
#: Share of an item's windows that re-parameterised windows must reach, in percent.
TEMPLATE_PERCENT = 50
#: Share of a template window's words that have to be literal, or slots filled alike, in percent.
LITERAL_PERCENT = 50
#: Words outside of slots that a template needs; others match word by word alone.  A window
#: of numbers alone says nothing, and every table of numbers would meet it.
MIN_LITERALS = 2
#: Benchmark windows that may be broadcast (about 200 bytes each); beyond, the join shuffles.
MAX_BROADCAST = 200_000
#: Bits of the filter of benchmark windows, at most (2 MB); a fuller one lets more through.
MAX_FILTER_BITS = 1 << 24
#: Different openings of benchmark windows that are looked for before windows are hashed; of more, none are.
MAX_VOCABULARY = 1_000_000
#: Words of a window that are its opening.
OPENING = 3
UNITS = (
    "mm cm km kg mg kilogram kilometer kilometre ounce gallon lb oz mph kmh ml meters metres meter metre miles mile feet foot inches inch kilometers kilometres "
    "grams gram kilograms pounds pound ounces liters litres liter litre gallons seconds second minutes minute hours hour "
    "days day weeks week months month years year dollars dollar cents cent euros euro percent degrees degree"
).split()
#: Spellings of a unit beside those that end in s.
SPELLINGS = {
    "meter": "metre", "foot": "feet", "inches": "inch", "kilometer": "km", "kilometre": "km", "gram": "grams", "kilogram": "kg", "lb": "pound", "oz": "ounce", "liter": "litre",
}
_NUMBER = r"\p{N}(?:[\p{N}.,]*\p{N})?"
_MARK = "\x01"
_ONES = "one two three four five six seven eight nine".split()
_TEENS = "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_SCALES = "hundred thousand million billion dozen".split()
#: Of one word and with an ending of their own; "second" is a unit.
_ORDINALS = "first third fifth eighth ninth twelfth half quarter zero".split()
#: Number words, the longest first, as a pattern takes the first that fits.
NUMBER_WORDS = sorted(
    [*_ONES, *_TEENS, *_TENS, *_SCALES, *_ORDINALS, *(f"{w}th" for w in ("four", "six", "seven", *_TEENS, *_SCALES[:4]) if w != "twelve"), *(f"{w[:-1]}ieth" for w in _TENS)],
    key=lambda w: (-len(w), w),
)
_ANY, _SCALE = "|".join(NUMBER_WORDS), "|".join(_SCALES)
_AFTER_TENS = "|".join([*_ONES, *"first third fourth fifth sixth seventh eighth ninth".split()])
#: Where a text may have a number of several words.
_COMPOUND = rf"[hH]undred|[tT]housand|[mM]illion|[bB]illion|[dD]ozen|[tT][yY][ -](?i:{_AFTER_TENS})"
#: What parts two words of one number: tens and ones, a scale from what it counts and from what follows it.
_IN_NUMBER = (
    rf"(?i)(?:[ -](?<=(?<!\p{{L}})(?:{'|'.join(_TENS)})[ -])(?=(?:{_AFTER_TENS})(?!\p{{L}}))|[ -](?<=(?<!\p{{L}})(?:{_ANY})[ -])(?=(?:{_SCALE})(?!\p{{L}}))"
    rf"|(?: and)?[ -](?<=(?<!\p{{L}})(?:{_SCALE})(?: and)?[ -])(?=(?:{_ANY})(?!\p{{L}})))"
)
#: What parts two words of one name; no line break, as a heading is no part of a name.
_IN_NAME = r"((?:\x01p|\G(?!^))(?:\p{L}++(?=[ \t-]\x01p)|(?:\p{Lu}|Mrs?|Ms|Dr|Prof|St)(?=\. \x01p)))(?:\. |[ \t-])\x01p"
def with_forms(rows: DataFrame) -> DataFrame:
    """``rows`` with narrow and wide in place of text: its words in either form; those
    that fill a slot are behind a mark and their type.  Texts without words go."""
    others = [c for c in rows.columns if c != "text"]
    rows = rows.select(*others, F.explode(F.array(_numbered(F.col("text")))).alias("text"))
    forms = F.struct(_words(_named(F.col("text"))).alias("narrow"), _bound(_words(_widely_named(F.col("text"))), _with_units).alias("wide"))
    return rows.select(*others, F.explode(F.array(forms)).alias("_w")).filter(F.size("_w.narrow") > 0).select(*others, "_w.*")


def with_words(rows: DataFrame) -> DataFrame:
    """``rows`` of with_forms with wide and words: a row for the narrow form and, where
    it is another, one for the wide form."""
    others = [c for c in rows.columns if c not in ("narrow", "wide")]
    forms = F.when(F.col("wide") == F.col("narrow"), F.array("narrow")).otherwise(F.array("narrow", "wide"))
    return rows.select(*others, F.posexplode(forms).alias("wide", "words"))


def _numbered(text: Column) -> Column:
    unit = "|".join(UNITS)
    with_numbers = F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}\x01])({_NUMBER})\s*(?i:({unit}))(?![\p{{L}}\p{{N}}])", " \x01n$1 \x01u$2 ")
    with_numbers = F.regexp_replace(with_numbers, rf"(?<![\p{{L}}\p{{N}}\x01.,])({_NUMBER})(?![\p{{L}}\p{{N}}])", " \x01n$1 ")
    with_numbers = F.when(text.rlike(r"\p{N}"), with_numbers).otherwise(text)
    return F.when(text.rlike(_COMPOUND), F.regexp_replace(with_numbers, _IN_NUMBER, "\x02")).otherwise(with_numbers)


def _named(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Lu}(?<=[\p{Ll}\p{N},;]\s\p{Lu})\p{L}*+(?!\p{N})", "\x01p$0")


def _widely_named(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\p{Lu}(?<![\p{L}\p{N}\x01]\p{Lu})\p{L}*+(?!\p{N})", "\x01p$0"), _IN_NAME, "$1\x02")


def _bound(value: Column, make) -> Column:
    """make(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _words(named: Column) -> Column:
    return F.transform(_bound(F.lower(named), _split), _number_word)


def _number_word(w: Column) -> Column:
    """The word behind a mark if it is a number, at the start of a sentence, too."""
    single = w.isin([x for n in NUMBER_WORDS for x in (n, _MARK + "p" + n)])
    return F.when(single | (w.contains("\x02") & ~w.startswith(_MARK)), F.concat(F.lit(_MARK + "n"), F.replace(w, F.lit(_MARK + "p"), F.lit("")))).otherwise(w)


def _with_units(words: Column) -> Column:
    """The words; any one right after a number is a unit."""
    number = _MARK + "n"
    after = F.transform(words, lambda w, i: F.when((i > 0) & F.get(words, i - 1).startswith(number) & ~w.startswith(_MARK), F.concat(F.lit(_MARK + "u"), w)).otherwise(w))
    return F.when(F.exists(words, lambda w: w.startswith(number)), after).otherwise(words)


def _split(lower: Column) -> Column:
    # points and commas inside numbers stay
    numbered = F.split(lower, r"(?:[^\p{L}\p{N}\x01\x02.,]|[.,](?!\p{N})|(?<!\p{N})[.,])+")
    return F.array_remove(F.when(lower.rlike(r"\p{N}"), numbered).otherwise(F.split(lower, r"[^\p{L}\p{N}\x01\x02]+")), "")


def _typed(words: Column) -> Column:
    return F.transform(words, lambda w: F.when(w.startswith(_MARK), F.substring(w, 1, 2)).otherwise(w))


def _plain(words: Column) -> Column:
    return F.transform(words, lambda w: F.when(w.startswith(_MARK), F.substring(w, F.lit(3), F.char_length(w))).otherwise(w))


def _fillers(words: Column) -> Column:
    return F.filter(words, lambda w: w.startswith(_MARK))


def _one_spelling(fillers: Column) -> Column:
    """The fillers with units in one spelling."""
    one = {u: u.removesuffix("s") for u in UNITS}
    one = {f"{_MARK}u{u}": f"{_MARK}u{SPELLINGS.get(u, SPELLINGS.get(v, v)).removesuffix('s')}" for u, v in one.items()}
    spelled = F.create_map(*[F.lit(x) for pair in one.items() for x in pair])
    return F.transform(fillers, lambda x: F.coalesce(F.try_element_at(spelled, x), F.regexp_replace(x, r"^(\x01u.+)s$", "$1")))


def _literals(words: Column) -> Column:
    """How many words fill no slot."""
    return F.size(F.filter(words, lambda w: ~w.startswith(_MARK)))


def _consistent(filled: Column) -> Column:
    """Whether fillers of the item stand for one of the document each, and names for different ones."""
    different = lambda pairs, side: F.size(F.array_distinct(F.transform(pairs, lambda x: x[side])))
    pairs = F.array_distinct(filled)
    names = F.filter(pairs, lambda x: x["item"].startswith(_MARK + "p"))
    return (F.size(pairs) == different(pairs, "item")) & (F.size(names) == different(names, "doc"))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(size, h, opening, item, item_id, n_same, item_wide, i, n_windows, item_words): the windows
    of every item, under their template and, in the narrow form, their plain form.

    Items of the same words are one ``item``, with the smallest item_id and their number."""
    forms = with_forms(benchmark.select("item_id", F.col("text").cast("string").alias("text")))
    items = forms.groupBy("narrow", "wide").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_same"))
    items = with_words(items.withColumn("item", F.sha2(F.concat_ws(" ", "narrow", F.array(F.lit("|")), "wide"), 256)))
    items = items.withColumn("size", F.least(F.lit(window), F.size("words")))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)
    # an array is hashed like its elements side by side
    hashes = lambda form: F.transform(starts, lambda i: F.xxhash64(F.slice(form, i, F.col("size"))))
    typed, plain = _hashed(_typed(F.col("words"))), _hashed(_plain(F.col("words")))
    openings = lambda form: F.transform(starts, lambda i: F.xxhash64(F.slice(form, i, F.least(F.lit(OPENING), F.col("size")))))
    both = F.arrays_zip(hashes(typed).alias("t"), hashes(plain).alias("p"), openings(typed).alias("to"), openings(plain).alias("po"))
    rows = items.select("item", "item_id", "n_same", F.col("wide").alias("item_wide"), "size", "words", F.posexplode(both).alias("at", "h2"))
    rows = rows.withColumn("i", F.col("at") + 1).withColumn("n_windows", F.size("words") - F.col("size") + 1)
    rows = rows.withColumn("item_words", F.slice("words", F.col("i"), F.col("size"))).withColumn("literals", _literals(F.col("item_words")))
    key = lambda name: F.struct(F.col(f"h2.{name}").alias("h"), F.col(f"h2.{name}o").alias("opening"))
    templates = F.when(F.col("literals") >= MIN_LITERALS, F.array(key("t"))).otherwise(F.array().cast("array<struct<h:bigint,opening:bigint>>"))
    keys = F.when(F.col("item_wide") == 1, templates).otherwise(F.array_distinct(F.concat(templates, F.array(key("p")))))
    return rows.select("item", "item_id", "n_same", "item_wide", "size", "n_windows", "i", "item_words", F.explode(keys).alias("_k")).select("*", "_k.h", "_k.opening").drop("_k")


def _bitmap(keys: DataFrame, n: int, max_bits: int) -> tuple[str, int]:
    """A filter of one bit for each key: its 64-bit words as a decimal list, and how many bits
    of a key tell its word."""
    power = max(0, (min(n, max_bits // 64) or 1).bit_length() - 1)
    rows = keys.toDF("h").groupBy(_word_of(F.col("h"), power).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("v")).collect()
    words = [0] * (1 << power)
    for r in rows:
        words[r["w"] - 1] = r["v"]
    return ",".join(map(str, words)), power


def _word_of(key: Column, power: int) -> Column:
    """The place, from 1, of the word of the filter that has the key's bit: its first bits tell."""
    return (F.shiftrightunsigned(key, 64 - power) + 1).cast("int") if power else F.lit(1)


def _held(bitmap: tuple[str, int], key: Column) -> Column:
    """Whether the filter may hold the key, which stands twice in the expression."""
    filled = F.split(F.lit(bitmap[0]), ",").cast("array<bigint>")
    return F.getbit(F.element_at(filled, _word_of(key, bitmap[1])), key.bitwiseAND(F.lit(63)).cast("int")) == 1


def _candidates(rows: DataFrame, filters: list[tuple[int, tuple[str, int], tuple[str, int] | None]]) -> DataFrame:
    """(others, size, at, h): the windows of each array of ``hashed`` words that a filter holds,
    of (size, filter of windows, filter of their openings or None).  Only those whose first
    words open a window of the benchmark are hashed as a whole.

    Positions are rows that live inside one generated loop: what does not pass is not written."""
    others = [c for c in rows.columns if c != "hashed"]
    n, at = F.size("hashed"), F.col("_place") + 1

    def opens(size: int, openings: tuple[str, int] | None) -> Column:
        # of one word: texts that have no other
        fits = n == 1 if size == 1 else at + (size - 1) <= n
        first = F.xxhash64(F.col("_first"), *[F.get("hashed", F.col("_place") + k) for k in range(1, min(size, OPENING))])
        return fits & _held(openings, first) if openings else fits

    def of_size(conditions: list[Column]) -> Column:
        chosen = F.lit(False)
        for (size, _, _), condition in zip(filters, conditions):
            chosen = F.when(F.col("size") == size, condition).otherwise(chosen)
        return chosen

    opened = [opens(size, openings) for size, _, openings in filters]
    placed = rows.select("*", F.posexplode("hashed").alias("_place", "_first")).filter(functools.reduce(Column.__or__, opened))
    placed = placed.select("*", F.explode(F.array(*[F.lit(size) for size, _, _ in filters])).alias("size")).filter(of_size(opened))
    whole = placed.select(*others, "size", at.alias("at"), F.xxhash64(F.slice("hashed", at, F.col("size"))).alias("h"))
    return whole.filter(of_size([_held(bitmap, F.col("h")) for _, bitmap, _ in filters]))


def text_key(text: Column) -> Column:
    return F.sha2(text.cast("string"), 256)


def matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST, max_filter_bits: int = MAX_FILTER_BITS, max_vocabulary: int = MAX_VOCABULARY
) -> DataFrame:
    """(text_key, item_id, n_same, plain, templates): contaminated texts, the items that they
    hold (items of the same words once, under the smallest id) and the windows of each.

    Words are hashed, and only where the first ones of a window open one of the benchmark's
    is the window hashed and looked up in a bitmap of the benchmark's hashes, all where it
    stands; only those that it holds become rows and are joined by hash.
    Expressions that several others use are bound or exploded from an array of one, so that
    they are computed once.  The limits choose between plans that give the same rows."""
    items = checkpoint(benchmark_windows(benchmark, window))
    n = items.count()
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    if not sizes:
        none = docs.sparkSession.createDataFrame([], "text_key string, item_id long, n_same long, plain long, templates long")
        return none.withColumn("item_id", F.col("item_id").cast(benchmark.schema["item_id"].dataType))
    words = with_words(with_forms(docs.select(text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text"))))
    slotted = F.exists("words", lambda w: w.startswith(_MARK))
    part = lambda begin, n: F.transform("words", lambda w: F.xxhash64(F.when(w.startswith(_MARK), F.substring(w, begin, n)).otherwise(w)))
    forms = F.struct(F.when(slotted, part(1, 2)).otherwise(_hashed(F.col("words"))).alias("typed"), F.when(slotted & (F.col("wide") == 0), part(3, 1 << 30)).alias("plain"))
    words = words.select("text_key", "wide", "words", F.explode(F.array(forms)).alias("forms"))
    filters = []
    for size in sizes:
        own = items.filter(F.col("size") == size)
        openings = own.select("opening").distinct()
        n_openings = openings.count()
        filters.append((size, _bitmap(own.select("h"), n, max_filter_bits), _bitmap(openings, n_openings, max_filter_bits) if n_openings <= max_vocabulary else None))
    keyed = _candidates(words.select("text_key", "wide", "words", F.explode(F.array("forms.typed", "forms.plain")).alias("hashed")), filters)
    keyed = keyed.select("text_key", "wide", F.size("words").alias("n_words"), "size", "at", F.slice("words", F.col("at"), F.col("size")).alias("doc_words"), "h")
    known = items.drop("opening")
    hits = keyed.join(F.broadcast(known) if n <= max_broadcast else known, ["size", "h"])
    a, b = _one_spelling(_fillers(F.col("doc_words"))), _one_spelling(_fillers(F.col("item_words")))
    plain = F.array_join(_plain(F.col("doc_words")), " ") == F.array_join(_plain(F.col("item_words")), " ")
    same = F.array_join(_typed(F.col("doc_words")), " ") == F.array_join(_typed(F.col("item_words")), " ")
    filled = F.arrays_zip(b.alias("item"), a.alias("doc"))
    literal = F.col("size") - F.size(F.filter(filled, lambda x: x["item"] != x["doc"]))
    template = same & (_literals(F.col("item_words")) >= MIN_LITERALS) & _consistent(filled) & (100 * literal >= LITERAL_PERCENT * F.col("size"))
    # a name that begins or ends an item may run on into the text around it
    name_at = lambda at: F.element_at("item_words", at).startswith(_MARK + "p")
    first, last = ((F.col("i") == 1) & name_at(1)).cast("int"), ((F.col("i") == F.col("n_windows")) & name_at(-1)).cast("int")
    inner = F.slice(filled, first + 1, F.greatest(F.size(filled) - first - last, F.lit(0)))
    judged = hits.filter((F.col("size") > 1) | (F.col("n_words") == 1))
    judged = judged.select("text_key", "item", "item_id", "n_same", "wide", "item_wide", "n_windows", "i", (F.col("at") - F.col("i")).alias("shift"), plain.alias("plain"), (plain | template).alias("fits"), inner.alias("filled")).filter("fits")
    # one occurrence of an item: windows at one shift, whose slots have to agree as a whole
    runs = judged.groupBy("text_key", "item", "wide", "item_wide", "shift").agg(
        F.first("item_id").alias("item_id"), F.first("n_same").alias("n_same"), F.max("n_windows").alias("n"),
        F.count_distinct("i").alias("templates"), F.count_distinct(F.when(F.col("plain"), F.col("i"))).alias("plain"),
        F.array_distinct(F.flatten(F.collect_set("filled"))).alias("filled"),
    )
    runs = runs.filter((F.col("plain") > 0) | (_consistent(F.col("filled")) & (F.col("templates") * 100 >= F.col("n") * TEMPLATE_PERCENT)))
    return runs.groupBy("text_key", "item").agg(F.first("item_id").alias("item_id"), F.first("n_same").alias("n_same"), F.max("plain").alias("plain"), F.max("templates").alias("templates")).drop("item")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **limits: int) -> DataFrame:
    """doc_id, contaminated, n_items, item_id (the smallest) for every row of ``docs``.

    Null and empty texts, texts without a letter or digit and, if the benchmark is
    empty, all texts are clean.  Each row is judged by its own text, whether its
    doc_id is null, repeated or neither; equal items count each in n_items.  Null
    items and those without a letter or digit match nothing.  Other columns of
    either table are not read.
    """
    found = matches(docs, benchmark, window, **limits)
    by_text = found.groupBy(F.col("text_key").alias("_key")).agg(F.sum("n_same").alias("_n"), F.min("item_id").alias("_item"))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("_text"))
    joined = rows.join(by_text, F.col("_text") == F.col("_key"), "left")
    return joined.select("doc_id", F.col("_n").isNotNull().alias("contaminated"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_items"), F.col("_item").alias("item_id"))


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, with all their columns."""
    gone = matches(docs, benchmark).select(F.col("text_key").alias("_gone")).distinct()
    return docs.join(gone, text_key(docs["text"]) == F.col("_gone"), "left_anti")
