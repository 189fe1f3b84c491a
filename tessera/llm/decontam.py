"""Benchmark decontamination by canonical templates, in DataFrame functions only.

Texts become tokens; numbers, names and units become typed placeholders, so that a question keeps its template when its
parameters change. Windows of a template are hash-joined with the benchmark's. Along each alignment of a document with
an item the placeholders' values are compared: where windows have changed values, an item's value must stand for one
value of the document throughout them. Windows that are equal word for word count in any case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, text_or_empty

#: Words that count as numbers, and units that count as such after a number.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg lb lbs pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros hz khz mhz ghz w kw v a c f k degrees degree kmh mph".split()

#: Bytes of rows, written out, that are sent to every executor; beyond it both sides of a join are shuffled.
BROADCAST_BYTES = 64 << 20
#: The lowest two bits of a code: among its tokens is a word; among them is a name read as a placeholder.
_WORD, _NAME = 1, 2
#: Tokens in a window, tokens of an item that must be found (all, if it has fewer), and the fewest tokens of an item inside a text.
WIDTH, RUN, LEAST = 8, 13, 5


def tokens(text: Column) -> Column:
    """Lower-case words and numbers. A name, which is a capitalised word inside a sentence, starts with '@'."""
    plain = F.replace(text, F.lit("@"), F.lit(" "))
    numbers = F.regexp_replace(plain, r"[.,](?<=\p{Nd}[.,])(?=\p{Nd})", "")
    spaced = F.regexp_replace(numbers, r"(\p{Nd})(\p{L})", "$1 $2")  # 5kg: 5 kg
    names = F.regexp_replace(spaced, r"\p{Lu}(?<=[\p{L}\p{Nd},] \p{Lu})\p{Ll}+", "@$0")
    return F.filter(F.split(F.lower(names), r"[^\p{L}\p{M}\p{N}@]+"), lambda x: x != "")


def placeholder(token: Column, before: Column | None) -> Column:
    """The type of a token: '#' number, '@' name, '%' unit (after a number); null for a word."""
    digit = lambda t: F.substring(t, 1, 1).between("0", "9")
    out = F.when(digit(token) | token.isin(NUMBER_WORDS), "#").when(token.startswith("@"), "@")
    return out if before is None else out.when(token.isin(UNITS) & digit(before), "%")


def _literal(token: Column) -> Column:
    """The code of a token as it stands."""
    return F.xxhash64(F.ltrim(token, F.lit("@"))).bitwiseAND(-4).bitwiseOR(_WORD)


def _coded(df: DataFrame) -> DataFrame:
    """`df` with named and plain: codes of `words` with names as placeholders, and with names as the words they are."""

    def code(x: Column, i: Column) -> Column:
        kind = placeholder(x, F.get("words", i - 1))
        coded = F.xxhash64(kind).bitwiseAND(-4)
        return F.when(kind.isNull(), _literal(x)).when(kind == "@", coded.bitwiseOR(_NAME)).otherwise(coded)

    def unnamed(c: Column, i: Column) -> Column:
        return F.when(c.bitwiseAND(_NAME) != 0, code(F.ltrim(F.get("words", i), F.lit("@")), i)).otherwise(c)

    return df.withColumn("named", F.transform("words", code)).withColumn("plain", F.transform("named", unnamed))


def _runs(df: DataFrame, name: str, width: int, join: Callable[[Column, Column], Column] = F.xxhash64) -> DataFrame:
    """`df` whose column `name` has, instead of a number for each token, one for each `width` tokens; null at the end.

    Those of 2, 4, 8 ... tokens are made from those of half as many, each a column of its own, so it is computed once.
    """
    behind = lambda c, k: F.slice(c, k + 1, F.greatest(F.size(c) - k, F.lit(0)))
    size, done, out = 1, 0, None
    power = f"_{name}1"
    df = df.withColumnRenamed(name, power)
    both = lambda a, b: F.when(b.isNotNull(), join(a, b))
    while True:
        if width & size:
            column = F.col(power) if out is None else F.zip_with(out, behind(power, done), both)
            out, done = f"_{name}_{done + size}", done + size
            df = df.withColumn(out, column)
        size *= 2
        if size > width:
            return df.withColumn(name, F.col(out)).drop(*(c for c in df.columns if c.startswith(f"_{name}")))
        df = df.withColumn(f"_{name}{size}", F.zip_with(power, behind(power, size // 2), both))
        power = f"_{name}{size}"


def _posted(df: DataFrame, width: int, *keep: str) -> DataFrame:
    """`keep`, at, h: a row for each window of `width` tokens in `words` and each of its readings.

    Names are read as words, and, where there are any, as placeholders. A window without any word stands for its values.
    Most texts have no names and not as many placeholders in a row; theirs is one reading, of one hash for each place.
    """
    none, flag = F.array().cast("array<bigint>"), lambda c, k: c.bitwiseAND(k) != 0
    bare = lambda codes: F.size(F.filter(codes, lambda c: ~flag(c, _WORD))) >= width
    words_in = lambda codes: F.transform(codes, lambda c: c.bitwiseAND(_WORD))
    named = F.exists("named", lambda c: flag(c, _NAME))
    df = df.withColumns(
        {
            "_size": F.size("words"),
            "values": F.when(bare("plain"), F.transform("words", _literal)).otherwise(none),
            "wordy": F.when(bare("plain"), words_in("plain")).otherwise(none),
            "wordy_named": F.when(named & bare("named"), words_in("named")).otherwise(none),
            "named": F.when(named, F.col("named")).otherwise(none),
        }
    )
    for name, join in (("plain", F.xxhash64), ("named", F.xxhash64), ("values", F.xxhash64), ("wordy", _either), ("wordy_named", _either)):
        df = _runs(df, name, width, join)
    has = lambda flags, i: (F.size(flags) == 0) | (F.get(flags, i) != 0)
    plain = F.transform("plain", lambda h, i: F.when(has("wordy", i), h).otherwise(F.get("values", i)))
    plain = F.when(F.size("wordy") > 0, plain).otherwise(F.col("plain"))
    named = F.transform("named", lambda h, i: F.when((h != F.get("plain", i)) & has("wordy_named", i), h))
    found = df.select(*keep, "_size", F.posexplode(F.concat(plain, named)).alias("_at", "h"))
    return found.where("h is not null").select(*keep, F.pmod("_at", "_size").alias("at"), "h")


def _either(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def _slots(item: Column, doc: Column) -> Column:
    """Pairs of values at the placeholders of two aligned windows, and where words differ."""

    def pair(a: Column, b: Column) -> Column:
        x, y = F.ltrim(a, F.lit("@")), F.ltrim(b, F.lit("@"))
        return F.struct(x.alias("a"), y.alias("b"), F.coalesce(placeholder(a, None).isNotNull() | (x != y), F.lit(False)).alias("slot"))

    return F.transform(F.filter(F.zip_with(item, doc, pair), lambda x: x.slot), lambda x: F.struct(x.a.alias("a"), x.b.alias("b")))


def _questions(benchmark: DataFrame, item: str) -> DataFrame:
    """item, item_hash, n, words, plain, named: the two readings of each item, alone and after a number inside a sentence."""
    texts = benchmark.select(F.col(item).alias("item"), text_or_empty().alias("t")).distinct().select("item", F.xxhash64("t").alias("item_hash"), "t")
    alone = _coded(texts.select("item", "item_hash", tokens(F.col("t")).alias("words")))
    inside = _coded(texts.select("item", "item_hash", tokens(F.concat(F.lit("1 "), "t")).alias("words")))
    rest = lambda c: F.slice(c, 2, F.size("words")).alias(c)
    both = alone.unionByName(inside.select("item", "item_hash", *(rest(c) for c in ("words", "named", "plain"))))
    return both.withColumn("n", F.size("words")).where("n > 0")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", width: int = WIDTH, run: int = RUN, least: int = LEAST
) -> DataFrame:
    """A row for each distinct (`key`, text) and item that it repeats, maybe with other parameters or in other case.

    Columns: `key`, text_hash, `item`, n_windows (of the item, found word for word or with consistent changes), n_slots
    (values compared) and n_changed (values that differ). An item counts as repeated when its windows found make up `run`
    tokens, or all tokens of a shorter item. Items of less than `width` tokens are matched as one window. Items of less
    than `least` tokens match only texts that have just their words, as phrases that short are in everyday texts; null
    or empty ones match nothing. Words are compared without case. Names are read as words and as placeholders, so a copy
    in other case is found by its words, and one with other names where they are capitalised like names. What goes before
    an item in a text may make its first word a name or a unit, so that word is matched in both readings. Windows of
    numbers, names and units alone are compared by their values. A null or empty text repeats nothing. Null keys and ids
    are kept as values; equal rows give one row, and items of equal id and text count as one. Other columns of either
    table are not read, so they may clash. Empty tables give no rows.
    """
    questions = stage(_questions(benchmark, item), "questions")
    widths = [r.w for r in questions.select(F.least("n", F.lit(width)).alias("w")).distinct().collect()]  # at most `width`
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("t"))
    rows = rows.select("key", F.xxhash64("t").alias("text_hash"), tokens(F.col("t")).alias("words"))
    coded, found = _coded(rows), None
    for w in widths or [width]:
        mine = questions.where(F.least("n", F.lit(width)) == w)
        asked = _posted(mine, w, "item", "item_hash", "n").withColumnRenamed("at", "item_at").distinct()
        posted = _posted(coded.where(F.size("words") == w) if w < least else coded, w, "key", "text_hash")
        hit = posted.join(_small(asked), "h").select("key", "text_hash", "at", "item", "item_hash", "n", "item_at", F.lit(w).alias("w"))
        found = hit if found is None else found.unionByName(hit)
    found = stage(found.distinct(), "hits")

    # The words of the windows found only: a text's words are cut once, and do not travel with its windows.
    wanted = found.groupBy("key", "text_hash").agg(F.collect_set(F.struct("at", "w")).alias("ats"))
    wanted = wanted.select(F.col("key").alias("k"), F.col("text_hash").alias("th"), "ats")
    texts = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("t")).withColumn("text_hash", F.xxhash64("t"))
    held = texts.join(_small(wanted), F.col("key").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("th"))).dropDuplicates(["key", "text_hash"])
    cut = held.select("key", "text_hash", "ats", tokens(F.col("t")).alias("words"))
    cut = cut.select("key", "text_hash", F.explode(F.transform("ats", lambda x: F.struct(x.at.alias("at"), x.w.alias("w"), F.slice("words", x.at + 1, x.w).alias("doc_words")))).alias("c"))
    cut = cut.select(F.col("key").alias("k"), F.col("text_hash").alias("th"), F.col("c.at").alias("a"), F.col("c.w").alias("cw"), "c.doc_words")
    same_place = F.col("key").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("th")) & (F.col("at") == F.col("a")) & (F.col("w") == F.col("cw"))
    names = questions.groupBy("item", "item_hash").agg(F.max("words").alias("item_tokens")).select(F.col("item").alias("i"), F.col("item_hash").alias("ih"), "item_tokens")
    hits = found.join(cut, same_place).join(_small(names), F.col("item").eqNullSafe(F.col("i")) & (F.col("item_hash") == F.col("ih")))
    hits = hits.withColumn("slots", _slots(F.slice("item_tokens", F.col("item_at") + 1, F.col("w")), F.col("doc_words")))

    changed = F.exists("slots", lambda s: s.a != s.b)
    hits = hits.where(~changed | (F.col("w") >= least)).withColumn("shift", F.col("at") - F.col("item_at"))
    places = lambda which: F.collect_set(F.when(which, F.col("item_at")))
    slots = lambda which: F.array_distinct(F.flatten(F.collect_set(F.when(which, F.col("slots")))))
    lines = hits.groupBy("key", "text_hash", "item", "item_hash", "n", "shift").agg(
        places(~changed).alias("same_places"), slots(~changed).alias("same"), places(changed).alias("changed_places"), slots(changed).alias("changed")
    )
    consistent = F.size("changed") == F.size(F.array_distinct(F.transform("changed", lambda s: s.a)))
    both = lambda a, b: F.when(consistent, F.array_union(a, b)).otherwise(F.col(a))
    kept = lines.select("key", "text_hash", "item", "item_hash", "n", both("same_places", "changed_places").alias("places"), both("same", "changed").alias("slots"))
    whole = kept.groupBy("key", "text_hash", "item", "item_hash", "n").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n_windows"),
        F.max(F.size("slots")).alias("n_slots"),
        F.max(F.size(F.filter("slots", lambda s: s.a != s.b))).alias("n_changed"),
    )
    need = F.least(F.col("n"), F.lit(run)) - F.least(F.col("n"), F.lit(width)) + 1
    numbers = [F.col(c).cast("long").alias(c) for c in ("n_windows", "n_slots", "n_changed")]
    return whole.where(F.col("n_windows") >= need).select(F.col("key").alias(key), "text_hash", F.col("item").alias(item), *numbers)


def _small(df: DataFrame) -> DataFrame:
    """`df`, to be broadcast if its rows are within BROADCAST_BYTES, and shuffled otherwise."""
    held = stage(df, "small")
    size = F.lit(64) + F.coalesce(F.octet_length(F.to_json(F.struct(*held.columns))), F.lit(0))
    return F.broadcast(held) if (held.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else held


def without_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, all their columns, that repeat no item of `benchmark`; see `contaminated`."""
    bad = contaminated(docs, benchmark, key, text).select(F.col(key).alias("_k"), F.col("text_hash").alias("_h")).distinct()
    return docs.join(_small(bad), docs[key].eqNullSafe(F.col("_k")) & (F.xxhash64(text_or_empty(text)) == F.col("_h")), "left_anti")
