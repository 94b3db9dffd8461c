"""Benchmark decontamination by template canonicalisation, with Spark expressions alone.

Words are runs of letters and digits, lower-cased (a number keeps its inner marks). Each text has two forms. In the canonical one a
run of capitalised words is a name placeholder (openers of sentences too, in documents and items alike; its value is the last word
of the run), digits and number words are number placeholders, and a unit after a number is a unit placeholder. The other form is
the plain words. Windows of five words are hashed; those of documents meet those of benchmark items in an equi-join, each
form with its own. Matches of one document and item are aligned by their distance (document position less item position). In
an alignment, the slots under placeholders must be consistent: equal values of the item stand for equal values of the document.

A document is contaminated by an item if a consistent alignment has four fifths of the item's windows, or nine of them (13 words).
Canonical windows with fewer than three plain words are left out, since placeholders alone match anything. Of plain words all windows
count, and all must match (copies that are exact but for case and marks); an item of under five words is one window of its
length, found wherever these words stand on end.

The join sends the windows' hashes of the benchmark to every task while there are at most ``WINDOWS_BROADCAST`` of them (32 MB), and
shuffles beyond. Only documents with matches are looked at again for their slots.

Defined cases: a null text is empty; items without words never match; rows with one doc_id
are one document (and those with a null id, which is kept); items with one item_id are aligned apart; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

WINDOW, LEAST_SHARE, LEAST_RUN, LEAST_PLAIN = 5, 0.8, 9, 3
BITMAP_BITS = 14
WINDOWS_BROADCAST, IDS_BROADCAST = 2_000_000, 1_000_000
#: Units of measure.
UNITS = (
    "kg", "g", "mg", "lb", "lbs", "oz", "t", "km", "m", "cm", "mm", "mi", "miles", "mile", "ft", "feet", "foot", "inch", "inches", "yd", "yards",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "l", "ml", "liter", "liters", "litre", "litres", "gallon", "gallons", "kmh", "mph", "percent", "dollars", "dollar", "cents", "euros", "euro", "degrees",
    "meter", "meters", "metre", "metres", "kilometers", "kilometres", "kilograms", "grams", "pounds", "w", "kw", "v", "hz", "j", "n", "pa", "k", "c", "f",
)
#: Number words.
NUMBERS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen",
    "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion",
)
NUMBER, UNIT, NAME = "#num", "#unit", "#name"
#: The forms, and what words are made of, as the inside of a character class.
CANONICAL, EXACT = 0, 1
WORD = r"\p{L}\p{N}_#"

def marked_text(text: Column) -> Column:
    """Words with one space between them; a word that anything but a single space comes before has a dot in front. A number keeps its inner marks as underscores."""
    t = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("#"), F.lit(" ")), F.lit("\n"), F.lit(". "))
    t = F.when(t.rlike("[0-9][.,][0-9]"), F.regexp_replace(t, "(?<=[0-9])[.,](?=[0-9])", "_")).otherwise(t)
    return F.rtrim(F.ltrim(F.regexp_replace(t, f"[^{WORD} ][^{WORD}]*| [^{WORD}]+", " .")), F.lit(" ."))


def _unmarked(x: Column) -> Column:
    return F.when(x < "/", F.substr(x, F.lit(2))).otherwise(x)


def _capital(x: Column) -> Column:
    """Latin letters are told by their place; only for others the first letter is lower-cased."""
    first = F.left(x, F.lit(1))
    return F.when(x < "a", (x >= "A") & (x < "[")).otherwise((x >= "\x80") & (F.lower(first) != first))


def _number(w: Column) -> Column:
    return ((w >= "0") & (w < ":")) | w.isin(*NUMBERS)


def with_forms(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with plain (lower-case words), canon (the canonical form) and canon_raw (the words it stands for, as many).

    Every step is a column of its own: an expression used twice, or inside a lambda, would be worked out again.
    """
    t = rows.withColumn("marked", marked_text(F.col(text)))
    t = t.withColumn("cased", F.when(F.col("marked") == "", F.array().cast("array<string>")).otherwise(F.split("marked", " ")))
    t = t.withColumns({
        "plain": F.transform("cased", lambda x: F.lower(_unmarked(x))),
        # 0: no name, 1: a name that may go on from the word before, 2: a name after a mark.
        "names": F.transform("cased", lambda x: F.when(x < "/", F.when(_capital(F.substr(x, F.lit(2))), 2).otherwise(0)).when(_capital(x), 1).otherwise(0)),
    })
    goes_on = lambda i: (F.get("names", i) > 0) & F.coalesce(F.get("names", i + 1) == 1, F.lit(False))
    unit = lambda w, i: w.isin(*UNITS) & (i > 0) & F.coalesce(_number(F.get("plain", i - 1)) & (F.get("names", i - 1) == 0), F.lit(False))
    kind = lambda w, i: F.when(F.get("names", i) > 0, NAME).when(_number(w), NUMBER).when(unit(w, i), UNIT).otherwise(w)
    last = lambda f: F.array_compact(F.transform("plain", lambda w, i: F.when(~goes_on(i), f(w, i))))
    return t.withColumns({"canon": last(kind), "canon_raw": last(lambda w, i: w)}).drop("marked", "cased", "names")


def _hashes(words: Column, form: Column) -> Column:
    return F.transform(words, lambda c: F.xxhash64(form, c))


def _key(hashes: Column, i: Column, width: int = WINDOW) -> Column:
    """The hash leaves out nulls, so words on end that are fewer than a window have the key of their own width."""
    return F.xxhash64(*[F.get(hashes, i + j) for j in range(width)])


def _starts(hashes: Column, width: int = WINDOW) -> Column:
    n = F.size(hashes) - width
    return F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))


def _outer(first: Column, last: Column) -> Column:
    """One number from the hashes of a window's outer words."""
    return first.bitwiseXOR(F.shiftrightunsigned(last, 1))


def _bit(h: Column) -> tuple[Column, Column]:
    """Which of the bitmap's longs, and which bit of it."""
    return F.shiftrightunsigned(h, 64 - BITMAP_BITS).cast("int"), h.bitwiseAND(F.lit(63)).cast("int")


def _bitmap(outer: DataFrame) -> Column:
    """A constant array of longs (128 KB, whatever the benchmark's size) with a bit for each number in column o."""
    at, bit = _bit(F.col("o"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    rows = outer.groupBy(at.alias("at")).agg(F.bit_or(one).alias("bits")).collect()
    longs = dict(map(tuple, rows))
    return F.from_json(F.lit(str([longs.get(i, 0) for i in range(1 << BITMAP_BITS)])), "array<bigint>")


def _may_hold(bitmap: Column, o: Column) -> Column:
    at, bit = _bit(o)
    return F.call_function("shiftrightunsigned", F.get(bitmap, at), bit).bitwiseAND(F.lit(1)) == 1


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items (item, form, item_id, raw, canon) and their usable windows (item, form, pos, key, first, last, width). item numbers the different rows and forms."""
    items = with_forms(benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct())
    forms = [F.struct(F.lit(k).alias("form"), F.col(r).alias("raw"), F.col(c).alias("canon")) for k, r, c in ((CANONICAL, "canon_raw", "canon"), (EXACT, "plain", "plain"))]
    items = items.select("item_id", "text", F.inline(F.array(*forms))).select(F.xxhash64("item_id", "text", "form").alias("item"), "form", "item_id", "raw", "canon")
    h = F.col("h")
    short = (F.col("form") == EXACT) & F.size(h).between(1, WINDOW - 1)
    at = items.select("item", "form", "canon", _hashes(F.col("canon"), F.col("form")).alias("h")).withColumn("width", F.least(F.size("h"), F.lit(WINDOW)))
    at = at.select("*", F.explode(F.when(short, F.array(F.lit(0))).otherwise(_starts(h))).alias("pos"))
    plain = F.size(F.filter(F.slice("canon", F.col("pos") + 1, WINDOW), lambda c: ~c.isin(NUMBER, UNIT, NAME)))
    usable = at.where((plain >= LEAST_PLAIN) | (F.col("form") == EXACT))
    return items, usable.select("item", "form", "pos", _key(h, F.col("pos")).alias("key"), F.get("h", "pos").alias("first"), F.get("h", F.col("pos") + F.col("width") - 1).alias("last"), "width")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched, item_windows (longs), share double, slots long: the best alignment of each contaminated pair."""
    scratch = Scratch(docs.sparkSession)
    # Read several times below, so both are written once.
    items, usable = (scratch.save(x, name) for x, name in zip(benchmark_windows(benchmark), ("items", "windows"), strict=True))
    sizes = usable.groupBy("item", "form").agg(F.count("*").alias("item_windows"))
    n = usable.count()
    near = lambda df, count, most: F.broadcast(df) if count <= most else df

    outer = _bitmap(usable.select(_outer(F.col("first"), F.col("last")).alias("o")))
    words = with_forms(docs.select("doc_id", "text"))
    hashed = words.select("doc_id", _hashes(F.col("canon"), F.lit(CANONICAL)).alias(f"h{CANONICAL}"), _hashes(F.col("plain"), F.lit(EXACT)).alias(f"h{EXACT}"))
    # Only windows whose outer words are those of one of the benchmark's are hashed; the join then decides.
    short = [r[0] for r in usable.where(F.col("width") < WINDOW).select("width").distinct().collect()]

    def likely(form: int, width: int) -> Column:
        h = F.col(f"h{form}")
        window = lambda i: F.struct(F.lit(form).alias("form"), i.alias("at"), _key(h, i, width).alias("key"))
        return F.array_compact(F.transform(h, lambda x, i: F.when(_may_hold(outer, _outer(x, F.get(h, i + width - 1))), window(i))))

    parts = [likely(k, WINDOW) for k in (CANONICAL, EXACT)] + [likely(EXACT, w) for w in sorted(short)]
    # Outer, as the filter that Spark infers from an inner one would be pushed down with all expressions written out inside each other.
    seen = hashed.select("doc_id", F.inline_outer(F.concat(*parts))).where("key is not null")
    keys = usable.select("item", "form", "pos", "key")
    matches = seen.join(near(keys, n, WINDOWS_BROADCAST), ["form", "key"]).select("doc_id", "item", (F.col("at") - F.col("pos")).alias("shift"), "pos").distinct()
    # At most as many positions as an item has windows meet in a group.
    aligned = matches.groupBy("doc_id", "item", "shift").agg(F.collect_list("pos").alias("positions"), F.count("*").alias("matched"))
    strong = aligned.join(near(sizes, n, WINDOWS_BROADCAST), "item")
    enough = (F.col("matched") >= LEAST_RUN) | (F.col("matched") >= LEAST_SHARE * F.col("item_windows"))
    strong = strong.where(F.when(F.col("form") == EXACT, F.col("matched") == F.col("item_windows")).otherwise(enough))
    strong = scratch.save(strong, "aligned")
    with_item = strong.join(near(items.drop("form"), n, WINDOWS_BROADCAST), "item")
    placeholders = F.filter(
        F.sequence(F.lit(0), F.size("canon") - 1),
        lambda p: F.get("canon", p).isin(NUMBER, UNIT, NAME) & F.exists("positions", lambda q: (p >= q) & (p < q + WINDOW)),
    )
    slotted = with_item.select("doc_id", "item", "form", "item_id", "shift", "matched", "item_windows", F.transform(placeholders, lambda p: F.struct(p.alias("p"), F.get("raw", p).alias("v"))).alias("slots"))
    # Alignments without slots are consistent; for the others the documents' words are needed.
    free = slotted.where(F.size("slots") == 0).withColumn("n_slots", F.lit(0))
    bound = slotted.where(F.size("slots") > 0)
    in_question = bound.withColumnRenamed("doc_id", "q_id")
    ids = in_question.select("q_id").distinct()
    # Filtered map-side while the ids may be broadcast, so that only the texts in question are shuffled.
    texts = docs.select("doc_id", "text").join(near(ids, ids.count(), IDS_BROADCAST), F.col("doc_id").eqNullSafe(F.col("q_id")), "left_semi")
    both = in_question.join(texts, F.col("doc_id").eqNullSafe(F.col("q_id")))
    values = with_forms(both.drop("canon", "raw")).withColumn("pairs", F.transform("slots", lambda s: F.struct(s["v"].alias("a"), F.coalesce(F.get("canon_raw", s["p"] + F.col("shift")), F.lit("")).alias("b"))))
    consistent = F.size(F.array_distinct("pairs")) == F.size(F.array_distinct(F.transform("pairs", lambda x: x["a"])))
    # Written before it is filtered: the filter would be pushed down with all expressions written out inside each other.
    tested = scratch.save(values.select("doc_id", "item_id", "matched", "item_windows", F.size("slots").alias("n_slots"), consistent.alias("ok")), "slots")
    checked = tested.where("ok")
    columns = ["doc_id", "item_id", "matched", "item_windows", "n_slots"]
    found = free.select(*columns).unionByName(checked.select(*columns))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("matched") / F.col("item_windows"), "matched", "item_windows", "n_slots")).alias("m"))
    return best.select(
        "doc_id", "item_id", F.col("m.matched").cast("long").alias("matched"), F.col("m.item_windows").cast("long").alias("item_windows"),
        (F.col("m.matched") / F.col("m.item_windows")).alias("share"), F.col("m.n_slots").cast("long").alias("slots"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no benchmark item contaminates, with the columns they came with."""
    bad = Scratch(docs.sparkSession).save(contaminated(docs, benchmark).select(F.col("doc_id").alias("bad_id")).distinct(), "bad")
    small = F.broadcast(bad) if bad.count() <= IDS_BROADCAST else bad
    return docs.join(small, docs.doc_id.eqNullSafe(bad.bad_id), "left_anti")
