"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders; what is left is lower-cased and split into
tokens without punctuation. Names that follow each other are one placeholder, and so are
numbers with a space between. Windows of ``size`` template tokens of the documents are joined by
hash with those of the benchmark items. A document holds an item if the matched windows lie on
neighbouring diagonals (distances between the two texts that differ by ``max_shift`` at most, so
that words may be inserted or left out) and reach ``min_share`` of the item's windows; windows
across an insertion count if all their tokens are matched.

The values in the slots lower that share: it is multiplied by the share of slots whose value
stands for one value of the other text, mean of both directions. With ``one_value`` a value of
the item that stands for two values of the document vetoes the hit; two values of the item may
always become one.

Names are capitalised words after a lower-case letter, digit or comma; units follow a number.
As an item's first word has nothing before it, each item is looked for in two forms, as it
stands and as after a lower-case word. Item windows with fewer than ``min_literals`` different
plain words are not used. Items of fewer tokens than ``size`` are one window of their own length.

Items that lack a usable window in one of the forms are also looked for word for word, as a run
of lower-cased tokens without placeholders; those without any letter only if ``wordless``.

All of it is DataFrame functions. The benchmark's windows are broadcast after a count, or
joined by shuffle when they are many. Words are looked for without placeholders only if there
are items that need it.

Nulls: null texts are empty and match nothing; a document with a null id is found like any other,
an item with a null id is left out. Every row is judged by itself, by a key of id and text: repeated rows count
once, and of the rows with one id the best hit of each item is returned. Ties of hits are broken by score,
windows, slots, the first place and the first row of the item. Windows that an item repeats give one hit for each diagonal. Texts of any
length are read whole, as one row each. Columns beyond id and text are not read, whatever their names. An
empty table on either side gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.llm.common import cut, join_smaller, text_or_empty

NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
#: Units of measure that count after a number (fixed values).
UNITS = (
    "%", "percent", "mm", "cm", "m", "km", "metres?", "meters?", "miles?", "feet", "foot", "inch(?:es)?", "mg", "g", "kg", "grams?",
    "pounds?", "lbs?", "tons?", "ml", "l", "litres?", "liters?", "seconds?", "minutes?", "hours?", "days?", "weeks?", "months?",
    "years?", "dollars?", "euros?", "cents?", "degrees?",
)
# Groups repeat possessively: nothing follows them, and Java would go one call deeper for each repeat of a long run.
_NUMBER = r"(?<![\p{L}\p{N}\ue000-\ue002])\p{Nd}+(?:[.,:/ ]\p{Nd}+)*+"  # "1 200" is one number
_NAME = r"\p{Lu}(?<=[\p{Ll}\p{Nd}][,;]? \p{Lu})\p{Ll}[\p{L}\p{M}]*(?: \p{Lu}\p{Ll}[\p{L}\p{M}]*)*+"  # the capital first: most places fail there
_UNIT = rf"(?i)(?<=\p{{Nd}} ?)(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])"
_VALUE = r"[\ue000-\ue002]([^\ue003]*)\ue003"


def marked(text: Column) -> Column:
    """The text with each slot as marker, value, end sign."""
    clean = F.regexp_replace(text, "[\ue000-\ue003]", " ")
    names = lambda t: F.regexp_replace(t, _NAME, f" {NAME}$0\ue003 ")
    units = F.regexp_replace(clean, _UNIT, f" {UNIT}$0\ue003 ")
    # Only texts with a digit have numbers and units.
    return F.when(text.rlike(r"\p{Nd}"), F.regexp_replace(names(units), _NUMBER, f" {NUMBER}$0\ue003 ")).otherwise(names(clean))


def template_tokens(text: Column) -> Column:
    """Lower-case words and placeholders of a text."""
    template = F.lower(F.regexp_replace(marked(text), r"([\ue000-\ue002])[^\ue003]*\ue003", "$1"))
    return F.filter(F.split(template, r"[^\p{L}\p{M}\p{N}\ue000-\ue002]+"), lambda t: t != "")


def plain_tokens(text: Column) -> Column:
    """Lower-case words and numbers of a text, without placeholders."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda t: t != "")


def windows(rows: DataFrame, keys: list[str], tokens: str, lengths: list[int]) -> DataFrame:
    """``keys, pos, length, h``: hashes of all windows of the given lengths, by position."""
    coded = rows.select(*keys, F.transform(tokens, lambda t: F.xxhash64(t)).alias("codes"))

    def hashed(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size("codes") - (n - 1))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(F.col("codes"), i, n)))

    parts = [
        coded.where(F.size("codes") >= n).select(
            *keys,
            F.lit(n).alias("length"),
            F.posexplode(hashed(n)).alias("pos", "h"),
        )
        for n in lengths
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 8,
    min_share: float = 0.5,
    min_literals: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    max_shift: int = 8,
    one_value: bool = True,
    wordless: bool = False,
) -> DataFrame:
    """``doc_id, item_id, n_windows, item_windows, share, n_slots, n_changed`` of every held item."""
    whole = cut(
        benchmark.where(F.col(item_col).isNotNull())
        .select(F.col(item_col).alias("item_id"), text_or_empty("text").alias("text"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    # Two forms: as it stands, and as after a lower-case word, which is taken off again.
    first, after = F.struct(F.lit(0).alias("form"), F.col("text").alias("t")), F.struct(F.lit(1).alias("form"), F.concat(F.lit("a "), "text").alias("t"))
    forms = whole.select("item_id", F.col("row").alias("whole"), F.explode(F.array(first, after)).alias("f"))
    forms = forms.select("item_id", "whole", (F.col("whole") * 2 + F.col("f.form")).alias("row"), F.col("f.t").alias("t"), F.col("f.form").alias("form"))
    items = cut(forms.select("item_id", "whole", "row", F.slice(template_tokens(F.col("t")), F.col("form") + 1, 1_000_000_000).alias("tokens"), F.col("t").alias("item_text")))
    found_schema = "doc_id {0}, item_id {1}, n_windows long, item_windows long, share double, n_slots long, n_changed long".format(
        dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    )
    none = docs.sparkSession.createDataFrame([], found_schema)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    texts = texts.withColumn("doc_key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"))

    usable = _item_windows(items, size)
    if usable is None:  # no item has a token
        return none
    plain = F.filter(F.slice("tokens", F.col("item_pos") + 1, F.col("length")), lambda t: ~t.rlike("^[\ue000-\ue002]"))
    usable = usable.where(F.size(F.array_distinct(plain)) >= min_literals)
    of_item = Window.partitionBy("item_row")
    usable = usable.withColumn("item_windows", F.count("*").over(of_item)).withColumn("item_at", F.collect_list("item_pos").over(of_item)).drop("tokens")
    usable = cut(usable)
    by_template = _by_template(texts, items, usable, size, min_share, max_shift, one_value) if usable.limit(1).count() else none

    # Items with a form that no template window stands for.
    lacking = items.where(F.size("tokens") > 0).join(usable.select(F.col("item_row").alias("row")).distinct(), "row", "left_anti").select(F.col("whole").alias("row")).distinct()
    exact = whole.join(lacking, "row").where(F.lit(wordless) | F.col("text").rlike(r"\p{L}"))
    exact = cut(exact.select("item_id", "row", plain_tokens(F.col("text")).alias("tokens")))
    of_exact = _item_windows(exact, size)
    if of_exact is None:
        return by_template
    of_exact = cut(of_exact.drop("tokens").withColumn("item_windows", F.count("*").over(of_item)))
    seen = windows(texts.select(*_DOC, plain_tokens(F.col("text")).alias("tokens")), _DOC, "tokens", _lengths(of_exact))
    hits = join_smaller(seen, of_exact, ["h", "length"], "inner")
    held = hits.groupBy(*_DOC, "item_row", "item_id", "item_windows", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.collect_set("item_pos").alias("at"))
    held = held.where(F.size("at") == F.col("item_windows")).groupBy("doc_id", "item_id").agg(F.max("item_windows").alias("item_windows"))
    by_words = held.select(
        "doc_id", "item_id", F.col("item_windows").alias("n_windows"), "item_windows", F.lit(1.0).alias("share"),
        F.lit(0).cast("long").alias("n_slots"), F.lit(0).cast("long").alias("n_changed"),
    )
    # A hit by template tells more of the same pair.
    by_template = cut(by_template)
    told = by_template.select(F.col("doc_id").alias("told_doc"), F.col("item_id").alias("told_item"))
    fresh = by_words.join(told, F.col("doc_id").eqNullSafe(F.col("told_doc")) & (F.col("item_id") == F.col("told_item")), "left_anti")
    return by_template.union(fresh.select(*by_template.columns))


#: What stands for a row of the documents: its key, and its id for the result.
_DOC = ["doc_key", "doc_id"]


def _lengths(of_items: DataFrame) -> list[int]:
    return sorted(r["length"] for r in of_items.select("length").distinct().collect())


def _item_windows(items: DataFrame, size: int) -> DataFrame | None:
    """``h, item_row, item_id, tokens, item_pos, length``: every item's windows of its own length, ``size`` at most."""
    rows = items.where(F.size("tokens") > 0)
    lengths = sorted(r["n"] for r in rows.select(F.least(F.size("tokens"), F.lit(size)).alias("n")).distinct().collect())
    if not lengths:
        return None
    out = windows(rows.withColumnRenamed("row", "item_row"), ["item_row"], "tokens", lengths).withColumnRenamed("pos", "item_pos")
    out = out.join(rows.select(F.col("row").alias("item_row"), "item_id", "tokens"), "item_row")
    return out.where(F.col("length") == F.least(F.size("tokens"), F.lit(size)))


def _by_template(texts: DataFrame, items: DataFrame, usable: DataFrame, size: int, min_share: float, max_shift: int, one_value: bool) -> DataFrame:
    seen = windows(texts.select(*_DOC, template_tokens(F.col("text")).alias("tokens")), _DOC, "tokens", _lengths(usable))
    hits = join_smaller(seen, usable.drop("item_at"), ["h", "length"], "inner")
    diagonals = hits.groupBy(*_DOC, "item_row", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.min("item_pos").alias("low"), F.max(F.col("item_pos") + F.col("length")).alias("high"), F.collect_set("item_pos").alias("at")
    )
    diagonals = diagonals.withColumn("n", F.size("at"))
    of_rows = usable.groupBy("item_row").agg(F.first("item_id").alias("item_id"), F.first("item_windows").alias("item_windows"), F.first("length").alias("length"), F.first("item_at").alias("item_at"))
    near = Window.partitionBy("doc_key", "item_row").orderBy("shift").rangeBetween(0, max_shift)
    banded = diagonals.withColumn("band", F.collect_list(F.struct("n", "shift", "low", "high", "at")).over(near)).select(*_DOC, "item_row", "shift", "band")
    banded = join_smaller(banded, cut(of_rows), "item_row", "inner").withColumn("at", F.array_sort(F.array_distinct(F.flatten("band.at"))))
    # Between two starts no further apart than a window is long, all tokens are matched.
    filled = F.flatten(
        F.transform("at", lambda s, i: F.when(F.get("at", i + 1) - s <= F.col("length"), F.sequence(s, F.get("at", i + 1) - 1)).otherwise(F.array(s)))
    )
    banded = banded.withColumn("n_windows", F.size(F.array_intersect("item_at", filled)).cast("long"))
    likely = banded.where(F.col("n_windows") >= min_share * F.col("item_windows"))
    likely = cut(likely.select(*_DOC, "item_row", "item_id", "item_windows", "shift", "n_windows", F.transform("band", lambda d: d.dropFields("at")).alias("band")))

    slots = F.regexp_count("item_text", F.lit(r"[\ue000-\ue002]"))
    slotted = items.withColumn("item_text", marked(F.col("item_text"))).where(slots > 0).select(F.col("row").alias("item_row"), "tokens", "item_text")
    judged = _consistent(likely.join(slotted, "item_row"), texts)
    keys = ["doc_key", "item_row", "shift"]
    share = F.col("n_windows") / F.col("item_windows")
    kept = likely.join(judged, keys, "left").withColumn("score", share * F.coalesce("consistent", F.lit(1.0)))
    kept = kept.where(F.col("score") >= min_share)
    if one_value:
        kept = kept.where(F.coalesce("forth", F.lit(1)) == 1)
    best = kept.groupBy("doc_id", "item_id").agg(
        F.max_by(
            F.struct("n_windows", "item_windows", "n_slots", "n_changed"),
            F.struct("score", "n_windows", F.coalesce("n_slots", F.lit(0)), -F.col("shift"), -F.col("item_row")),
        ).alias("b")
    )
    return best.select(
        "doc_id", "item_id", "b.n_windows", "b.item_windows", (F.col("b.n_windows") / F.col("b.item_windows")).alias("share"),
        F.coalesce("b.n_slots", F.lit(0)).cast("long").alias("n_slots"), F.coalesce("b.n_changed", F.lit(0)).cast("long").alias("n_changed"),
    )


def _consistent(slotted: DataFrame, texts: DataFrame) -> DataFrame:
    """For candidates with slots: the share of slots where item and document values stand for each other, and the most values of one item value."""
    keys = ["doc_key", "item_row", "shift"]
    slotted = cut(slotted.drop("doc_id"))
    held = join_smaller(texts, cut(slotted.select("doc_key").distinct()), "doc_key", "left_semi").dropDuplicates(["doc_key"])

    def placed(tokens: Column, text: Column) -> Column:
        """Tokens of the marked text with values in their places: markers carry their value."""
        kept = F.regexp_replace(text, r"([\ue000-\ue002])\s*([^\ue003]*)\ue003", "$1")
        values = F.regexp_extract_all(text, F.lit(_VALUE), 1)
        return F.struct(kept.alias("template"), values.alias("values"), tokens.alias("tokens"))

    def slot_table(rows: DataFrame, by: list[str], tokens: str, text: str) -> DataFrame:
        """``by, pos, value`` of all slots: the n-th placeholder token has the n-th value."""
        rows = rows.select(*by, placed(F.col(tokens), F.col(text)).alias("p"))
        tokens_at = F.filter(
            F.transform("p.tokens", lambda t, i: F.when(t.rlike("^[\ue000-\ue002]$"), i)), lambda i: i.isNotNull()
        )
        pairs = F.arrays_zip(tokens_at.alias("pos"), F.col("p.values").alias("value"))
        return rows.select(*by, F.explode(pairs).alias("s")).select(*by, F.col("s")["pos"].alias("pos"), F.replace(F.lower(F.col("s")["value"]), F.lit(" "), F.lit("")).alias("value"))

    in_items = slot_table(slotted.select("item_row", "tokens", "item_text").dropDuplicates(["item_row"]), ["item_row"], "tokens", "item_text")
    in_docs = slot_table(
        held.select("doc_key", template_tokens(F.col("text")).alias("tokens"), marked(F.col("text")).alias("text")), ["doc_key"], "tokens", "text"
    )
    # Of the diagonals that pass over a slot, that with the most windows places it.
    wanted = slotted.select(*keys, F.explode("band").alias("d")).join(in_items.withColumnRenamed("value", "item_value"), "item_row")
    wanted = wanted.where((F.col("pos") >= F.col("d.low")) & (F.col("pos") < F.col("d.high")))
    wanted = wanted.groupBy(*keys, "pos", "item_value").agg(F.max_by("d.shift", F.struct("d.n", -F.col("d.shift"))).alias("of_slot"))
    wanted = wanted.withColumn("pos", F.col("pos") + F.col("of_slot"))
    pairs = wanted.join(in_docs, ["doc_key", "pos"]).groupBy(*keys, "item_value", "value").agg(F.count("*").alias("n"))
    pairs = pairs.withColumn("changed", F.when(F.col("item_value") != F.col("value"), F.col("n")).otherwise(0))
    forth = pairs.groupBy(*keys, "item_value").agg(F.count("*").alias("kinds"), F.max("n").alias("most"), F.sum("n").alias("n"), F.sum("changed").alias("c"))
    back = pairs.groupBy(*keys, "value").agg(F.max("n").alias("most"))
    forth = forth.groupBy(*keys).agg(F.max("kinds").alias("forth"), F.sum("most").alias("there"), F.sum("n").alias("n_slots"), F.sum("c").alias("n_changed"))
    back = back.groupBy(*keys).agg(F.sum("most").alias("here"))
    share = (F.col("there") + F.col("here")) / (2 * F.col("n_slots"))
    return forth.join(back, keys).select(*keys, share.alias("consistent"), "forth", "n_slots", "n_changed")
