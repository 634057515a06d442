"""Benchmark leaks, re-parameterised ones included, by joining windows of canonical templates.

Numbers, names and units become typed placeholders that keep their value aside: a number with its inner separators; a
capitalised word inside a sentence; a unit after a number. Words are lower-cased, other characters separate. Every window
of ``WINDOW`` tokens of the canonical form is hashed, of items and documents alike. A window with names has a second form
in which they are plain words, so that copies in another case are met too. Windows are joined on their hash; matches of
one item in one document at one shift are gathered, and the values in their slots must follow one substitution: each value
of the item always has the same value in the document, and different values stay different. That is asked of the windows
with names as slots, of those with names as words, and of both together; one of the three is enough. The tokens under the
matched windows are counted, each once. A leak covers at least ``SHARE`` of the item's tokens at one shift, or ``RUN`` of
them. Items under WINDOW tokens say little as a template: they are met whole, with their own values, in any case.

Everything is DataFrame functions; Spark decides from its size whether the item side is broadcast.

Defined results: null or empty texts and items match nothing; repeated documents are reported once per doc_id; repeated
items each; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW, SHARE, RUN = 6, 0.5, 13

# Units that may follow a number.
UNITS = "km|cm|mm|m|kg|mg|g|lb|lbs|oz|l|ml|mph|kmh|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|feet|foot|inch(?:es)?|dollars?|cents?|euros?|percent|degrees?|watts?|volts?"


def _tokens(text: Column) -> Column:
    """Words in lower case, and slots such as ``⟨n3.5⟩``, ``⟨pParis⟩`` and ``⟨ukm⟩``."""
    t = F.regexp_replace(text, "[⟨⟩]", " ")
    t = F.when(t.rlike(r"\p{N}"), F.regexp_replace(F.regexp_replace(t, r"\p{N}+(?:[.,:/]\p{N}+)*", " ⟨n$0⟩ "), rf"(?<=⟩ ) ?((?i:{UNITS}))(?![\p{{L}}\p{{N}}])", "⟨u$1⟩")).otherwise(t)
    t = F.when(t.rlike(r"\p{Lu}"), F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), r"(?<=[\p{Ll},;] )\p{Lu}\p{M}*\p{Ll}[\p{L}\p{M}]*", "⟨p$0⟩")).otherwise(t)
    return F.regexp_extract_all(F.lower(t), F.lit(r"⟨[^⟩]*⟩|[\p{L}\p{M}]+"), F.lit(0))


def _windows(df: DataFrame, key: str, short: list[int]) -> DataFrame:
    """``(key, n, pos, form, width, hash, slots)`` per window; slots are the placeholders with their values, in order. Form 0 has
    no names, form 1 has them as slots, form 2 as words, form 3 is a whole text of one of the ``short`` lengths."""
    marked = df.select(key, _tokens(F.col("text")).alias("raw")).where(F.size("raw") > 0)
    slot = lambda t: F.startswith(t, F.lit("⟨"))
    name = lambda t: F.startswith(t, F.lit("⟨p"))
    hashes = "transform(raw, t -> xxhash64({}))"
    plain = "if(startswith(t, '⟨p'), substring(t, 3, length(t) - 3), t)"
    marked = marked.select(
        key, "raw", F.size("raw").alias("n"), F.expr(hashes.format("if(startswith(t, '⟨'), substring(t, 1, 2), t)")).alias("named"),
        F.expr(hashes.format("if(startswith(t, '⟨p'), substring(t, 3, length(t) - 3), if(startswith(t, '⟨'), substring(t, 1, 2), t))")).alias("spelled"),
        (F.expr(hashes.format(plain)) if short else F.lit(None).cast("array<bigint>")).alias("exact"))
    # no function with a lambda from here on: these rows are many, and code is compiled for them
    at = lambda column, k: F.get(column, F.col("pos") + k)
    rows = marked.select("*", F.explode(F.expr("sequence(0, n - 1)")).alias("pos"))
    full = F.col("pos") + WINDOW <= F.col("n")
    hashed = lambda column, size: F.xxhash64(F.lit(size), *[at(column, k) for k in range(size)])
    both = F.struct(F.lit(1).alias("form"), F.lit(WINDOW).alias("width"), hashed("named", WINDOW).alias("hash"))
    only = F.struct(F.lit(0).alias("form"), F.lit(WINDOW).alias("width"), hashed("named", WINDOW).alias("hash"))
    words = F.struct(F.lit(2).alias("form"), F.lit(WINDOW).alias("width"), hashed("spelled", WINDOW).alias("hash"))
    same = reduce(lambda x, y: x & y, [at("named", k) == at("spelled", k) for k in range(WINDOW)])
    forms = F.when(~full, F.array().cast("array<struct<form:int,width:int,hash:bigint>>")).when(same, F.array(only)).otherwise(F.array(both, words))
    if short:
        whole = [F.when(F.col("pos") + size <= F.col("n"), F.struct(F.lit(3).alias("form"), F.lit(size).alias("width"), F.xxhash64(F.lit(-size), *[at("exact", k) for k in range(size)]).alias("hash"))) for size in short]
        forms = F.concat(forms, F.array_compact(F.array(*whole)))
    rows = rows.select(key, "n", "pos", "raw", F.explode(forms).alias("w")).select(key, "n", "pos", "raw", "w.form", "w.width", "w.hash")
    kept = F.array(*[F.when(slot(at("raw", k)) & ~((F.col("form") == 2) & name(at("raw", k))), at("raw", k)).otherwise("") for k in range(WINDOW)])
    return rows.select(key, "n", "pos", "form", "width", "hash", F.when(F.col("form") == 3, F.array().cast("array<string>")).otherwise(F.array_remove(kept, "")).alias("slots"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, shift, covered, item_tokens, share, renamed)`` for every document and item that leaked into it."""
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    sizes = named.select(F.size(_tokens(F.col("text"))).alias("n")).where(F.col("n").between(1, WINDOW - 1)).distinct()
    short = sorted(r["n"] for r in sizes.collect())
    items = stored(_windows(named, "item_id", short).where((F.col("form") < 3) | (F.col("width") == F.col("n"))).select(
        "item_id", F.col("n").alias("item_tokens"), F.col("pos").alias("item_pos"), F.col("form").alias("item_form"), "hash", F.col("slots").alias("item_slots")), "items")
    found = _windows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", short).join(items, "hash")
    readings = F.when((F.col("form") == 1), F.array(F.lit(0), F.lit(1))).when((F.col("form") == 2) | (F.col("item_form") == 2), F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))
    found = found.select("doc_id", "item_id", "item_tokens", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"), "item_slots", "slots", F.explode(readings).alias("reading"))
    pairs = F.transform(F.arrays_zip(F.col("item_slots").alias("x"), F.col("slots").alias("y")), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    at_shift = found.groupBy("doc_id", "item_id", "item_tokens", "shift", "reading").agg(
        F.sort_array(F.collect_set("item_pos")).alias("at"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
    consistent = (F.size(F.array_distinct(F.transform("pairs", lambda p: p["x"]))) == F.size("pairs")) & (F.size(F.array_distinct(F.transform("pairs", lambda p: p["y"]))) == F.size("pairs"))
    # a window adds the tokens up to the next one, or all of its own
    width = F.least(F.lit(WINDOW), F.col("item_tokens"))
    steps = F.transform("at", lambda p, i: F.least(F.coalesce(F.get("at", i + 1) - p, width), width))
    covered = F.aggregate(steps, F.lit(0), lambda s, x: s + x).cast("long")
    scored = at_shift.where(consistent).select("doc_id", "item_id", "shift", covered.alias("covered"), F.col("item_tokens").cast("long").alias("item_tokens"),
                                               F.exists("pairs", lambda p: p["x"] != p["y"]).alias("renamed"))
    best = scored.where((F.col("covered") >= SHARE * F.col("item_tokens")) | (F.col("covered") >= RUN)).groupBy("doc_id", "item_id").agg(
        F.max(F.struct("covered", (-F.col("shift")).alias("back"), "item_tokens", (~F.col("renamed")).alias("same"))).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.back")).cast("long").alias("shift"), "b.covered", "b.item_tokens", (F.col("b.covered") / F.col("b.item_tokens")).alias("share"), (~F.col("b.same")).alias("renamed"))
