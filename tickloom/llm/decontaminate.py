"""Benchmark decontamination by templates.

Numbers, units and names become typed placeholders, everything else lower-case words, so a question with
other values keeps its template. Windows of template words of documents and benchmark items are joined
by hash. Where enough of an item's windows are found in a document on one alignment, the values in the
slots are compared: each value of the item must stand for one value of the document wherever it
occurs. An item that has no window with enough literal words (a short one, or one of numbers) is looked for
as a whole, with its own values. DataFrame expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_key, written

#: Units that follow a number; a fixed list.
UNITS = "km|m|cm|mm|kg|g|mg|l|ml|s|ms|h|min|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|feet|inch(?:es)?|pounds?|euros?|dollars?|cents?|percent|mph|kmh"
NUMBER, UNIT, NAME = "0", "2", "1"
#: Repetitions are possessive: nothing behind them asks for less, and Java walks them without its stack, however long.
NUMBER_PATTERN = r"\p{N}++(?:[.,:]\p{N}++)*+"
#: A capital inside a sentence: after a small letter and at most a comma (texts in capitals have no names).
NAME_PATTERN = r"(\p{Ll}[,;]? )\p{Lu}\p{L}*+(?: \p{Lu}\p{L}*+)*+"


@dataclass(frozen=True)
class TemplateRules:
    """`window`: words a window has; `literal`: words of it that are no placeholders, at least.
    `share`: part of an item's windows that a document must hold; `consistent`: part of an item's
    distinct values that must map to one value. Items without such a window are found by all their words, in
    windows of that size or of their own if they are shorter, and with the same values only if their literal words
    are fewer than `literal`; of fewer than `least` words an item says nothing ("yes", "Part one").
    `small`: benchmark windows that are broadcast at most."""

    window: int = 8
    literal: int = 5
    least: int = 4
    share: float = 0.5
    consistent: float = 0.8
    small: int = 200_000


def template(text: Column) -> Column:
    """Array of template words. After the first replacement digits stand for placeholders only."""
    numbers = F.regexp_replace(text, NUMBER_PATTERN, NUMBER)
    units = F.regexp_replace(numbers, rf"(?i)0 ?(?:{UNITS})\b", f"{NUMBER} {UNIT}")
    names = F.regexp_replace(units, NAME_PATTERN, f"$1{NAME}")
    return F.array_remove(F.split(F.lower(names), r"[^\p{L}\p{M}0-2]+"), "")


def slot_values(text: Column) -> Column:
    """The values behind the NUMBER and NAME placeholders, each kind in order: struct of two arrays."""
    plain = F.regexp_replace(F.regexp_replace(text, NUMBER_PATTERN, NUMBER), rf"(?i)0 ?(?:{UNITS})\b", f"{NUMBER} {UNIT}")
    return F.struct(
        F.regexp_extract_all(text, F.lit(NUMBER_PATTERN), F.lit(0)).alias("numbers"),
        F.transform(F.regexp_extract_all(plain, F.lit(NAME_PATTERN), F.lit(0)), lambda x: F.lower(F.regexp_extract(x, r" (\p{Lu}.*)$", 1))).alias("names"),
    )


def windows_of(words: Column, sizes: list[int]) -> Column:
    """Array of (at, hash) of every window of the given sizes."""

    def of_size(w: Column, size: int) -> Column:
        return F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - (size - 1), F.lit(0))),
            lambda x, i: F.struct(i.alias("at"), F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)]).alias("h")),
        )

    return let(words, lambda w: of_size(w, sizes[0]) if len(sizes) == 1 else F.concat(*[of_size(w, size) for size in sizes]))


def is_slot(word: Column) -> Column:
    return word.isin(NUMBER, NAME, UNIT)


def literals(words: Column) -> Column:
    return F.size(F.filter(words, lambda v: ~is_slot(v)))


def benchmark_windows(benchmark: DataFrame, rules: TemplateRules) -> DataFrame:
    """(item_id, item_key, size, item_at, h, n_item, whole, strict): windows with enough literal words, or all windows
    of an item that has none such (`whole`: all must be found; `strict`: with the same values). n_item counts an
    item's windows. Items that share an id are kept apart by their text."""
    items = benchmark.select("item_id", text_key(F.col("text")).alias("item_key"), F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("w", template(F.col("text")))
    rich = lambda w: F.filter(F.transform(w, lambda x, i: F.when(literals(F.slice(w, i + 1, rules.window)) >= rules.literal, i)), lambda i: i.isNotNull() & (i + rules.window <= F.size(w)))
    sized = items.filter(F.size("w") >= rules.least).withColumns({"size": F.least(F.size("w"), F.lit(rules.window)), "at": rich(F.col("w"))})
    sized = sized.withColumn("whole", F.size("at") == 0).withColumns({"at": F.when(F.col("whole"), F.sequence(F.lit(0), F.size("w") - F.col("size"))).otherwise(F.col("at")), "strict": F.col("whole") & (literals(F.col("w")) < rules.literal)})
    hashed = F.coalesce(*[F.when(F.col("size") == k, F.transform(windows_of(F.col("w"), [k]), lambda x: x["h"])) for k in range(rules.least, rules.window + 1)])
    return sized.withColumn("hs", hashed).select("item_id", "item_key", "size", F.size("at").cast("long").alias("n_item"), "whole", "strict", "hs", F.explode("at").alias("item_at")).withColumn("h", F.get("hs", F.col("item_at"))).drop("hs")


def template_matches(docs: DataFrame, benchmark: DataFrame, rules: TemplateRules = TemplateRules()) -> DataFrame:
    """(doc_id, tk, item_id, n_windows, share, n_slots, n_consistent, same_values) of contaminated documents.

    A benchmark of up to `rules.small` windows is broadcast; a larger one is joined by shuffle.
    Defined cases: null texts are empty and match nothing; repeated documents give one row an item;
    empty tables give no row; other columns are not read.
    """
    bench = written(benchmark_windows(benchmark, rules), "benchmark-windows")
    counted = bench.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("size")).alias("sizes")).first()
    side = F.broadcast(bench) if counted.n <= rules.small else bench
    sizes = counted.sizes or [rules.window]  # of few different ones: `least` to `window`
    texts = docs.select("doc_id", text_key(F.col("text")).alias("tk"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.select("doc_id", "tk", F.explode(windows_of(template(F.col("text")), sizes)).alias("x")).select("doc_id", "tk", F.col("x.at").alias("at"), F.col("x.h").alias("h"))
    of_item = ["item_id", "item_key", "n_item", "whole", "strict"]
    hits = written(found.join(side, "h").select("doc_id", "tk", *of_item, (F.col("at") - F.col("item_at")).alias("shift"), "item_at").distinct(), "template-hits")
    # an alignment of at least two windows, or the one window an item has
    runs = hits.groupBy("doc_id", "tk", *of_item, "shift").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("item_at")).alias("places")).filter("n >= least(2, n_item) AND (n = n_item OR NOT whole)")
    enough = runs.groupBy("doc_id", "tk", *of_item).agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("distinct_windows"), F.max(F.struct("n", "shift")).alias("best"), F.collect_list(F.when(F.col("whole"), F.col("shift"))).alias("shifts"))
    enough = written(enough.filter(F.col("distinct_windows") >= rules.share * F.col("n_item")).withColumn("shifts", F.when(F.col("whole"), F.col("shifts")).otherwise(F.array("best.shift"))).drop("best"), "template-candidates")

    named = written(enough.select("doc_id", "tk").distinct(), "template-documents")
    same = [F.col("doc_id").eqNullSafe(F.col("_d")), F.col("tk") == F.col("_k")]
    chosen = texts.join(named.select(F.col("doc_id").alias("_d"), F.col("tk").alias("_k")), same, "left_semi").dropDuplicates(["doc_id", "tk"])
    doc_side = chosen.select(F.col("doc_id").alias("_d"), F.col("tk").alias("_k"), template(F.col("text")).alias("dw"), slot_values(F.col("text")).alias("dv"))
    items = benchmark.select(F.col("item_id").alias("_i"), text_key(F.col("text")).alias("_ik"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    item_side = items.select("_i", "_ik", template(F.col("text")).alias("iw"), slot_values(F.col("text")).alias("iv"))
    both = enough.join(doc_side, [F.col("doc_id").eqNullSafe(F.col("_d")), F.col("tk") == F.col("_k")]).join(item_side, [F.col("item_id").eqNullSafe(F.col("_i")), F.col("item_key") == F.col("_ik")])

    def value(words: Column, values: Column, at: Column) -> Column:
        """What stands at a slot: the value whose number among its kind is the slot's. Each value is one character
        of the template words, also where it is glued to letters ('covid0')."""
        kind = F.get(words, at)
        before = F.array_join(F.slice(words, 1, at), "")
        nth = F.length(before) - F.length(F.replace(before, kind, F.lit("")))
        return F.when(kind == NUMBER, F.get(values["numbers"], nth)).otherwise(F.get(values["names"], nth))

    def slots(r: Column) -> Column:
        shift = r["shift"]
        at = F.filter(F.transform(r["iw"], lambda x, i: F.when(x.isin(NUMBER, NAME) & (F.get(r["dw"], F.greatest(i + shift, F.lit(0))) == x) & (i + shift >= 0), i)), lambda x: x.isNotNull())
        return F.transform(at, lambda i: F.struct(F.concat(F.get(r["iw"], i), F.lit(" "), value(r["iw"], r["iv"], i)).alias("a"), value(r["dw"], r["dv"], i + shift).alias("b")))

    # a short item may stand at several places, and one with the right values is enough
    paired = both.withColumn("shift", F.explode("shifts")).withColumn("slots", let(F.struct("iw", "iv", "dw", "dv", "shift"), slots))
    distinct = F.array_distinct(F.transform("slots", lambda s: s["a"]))
    single = F.filter(distinct, lambda a: F.size(F.array_distinct(F.transform(F.filter("slots", lambda s: s["a"] == a), lambda s: s["b"]))) == 1)
    equal = F.forall("slots", lambda s: F.coalesce(F.substr(s["a"], F.lit(3)) == s["b"], F.lit(False)))
    judged = paired.select(
        "doc_id", "tk", "item_id", "item_key", "shift", "strict", F.col("distinct_windows").cast("long").alias("n_windows"), (F.col("distinct_windows") / F.col("n_item")).alias("share"), F.size(distinct).cast("long").alias("n_slots"), F.size(single).cast("long").alias("n_consistent"), equal.alias("same_values"),
    ).filter((F.col("n_consistent") >= rules.consistent * F.col("n_slots")) & (F.col("same_values") | ~F.col("strict")))
    shown = F.struct("n_windows", "share", "n_slots", "n_consistent", "same_values")
    return judged.groupBy("doc_id", "tk", "item_id", "item_key").agg(F.max_by(shown, F.struct("same_values", "shift")).alias("m")).select("doc_id", "tk", "item_id", "m.*")


def contaminated(docs: DataFrame, benchmark: DataFrame, rules: TemplateRules = TemplateRules()) -> DataFrame:
    return template_matches(docs, benchmark, rules).drop("tk")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, rules: TemplateRules = TemplateRules()) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns.

    Defined cases: null and empty texts stay; repeated rows stay or go together; an empty benchmark takes nothing;
    an empty table stays empty; columns of any name stay as they are.
    """
    bad = written(template_matches(docs, benchmark, rules).select(F.col("doc_id").alias("_bad_id"), F.col("tk").alias("_bad_tk")).distinct(), "contaminated")
    keyed = docs.select(F.struct(*docs.columns).alias("_doc"), text_key(F.col("text")).alias("_own"))
    return keyed.join(bad, F.col("_doc.doc_id").eqNullSafe(F.col("_bad_id")) & (F.col("_own") == F.col("_bad_tk")), "left_anti").select("_doc.*")
