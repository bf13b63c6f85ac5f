"""Quality rules whose cutoffs come from the data.

Every document gets integer counts. A mergeable quantile sketch (a log-linear histogram: exact below 64,
relative error 1/32 above) of each rate is kept per language, source and metric; sketches of one language
add up to the language's, and these to the corpus's, by summing counts. A document is measured by the first
level whose sketch holds enough documents: its source (in its language), its language, the corpus.

The fence lies `fence` spreads above the upper eighth; the spread is the distance of the eighths, and for one
document at least that of its own counting noise: a count of about c comes out as c give or take its root,
so a short text may hold a few symbols where most hold none. Where a group's eighths are equal, as they are for symbols and
repeated lines in the given tables, they say nothing of what lies above them: there a rate must pass the group's tail cutoff
too, the middle (of logarithms) of the widest step between the group's upper 64ths. It comes from ranks, so it is the same
for a group of any size, and parts what a few documents have from what the others have wherever that begins.

All of it is DataFrame expressions: the sketch is one partial aggregation (a hot source shrinks to
its few buckets before the shuffle), and a text is walked inside its own row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, written

WORD_BREAK = "[ \t-\r]+"
#: Bits that hold a word's position next to its window's hash.
POSITION_BITS = 31
METRICS = ("symbol_rate", "dup_line_rate", "repeat_rate", "word_size_high", "word_size_low")
#: Rates are counts in so many words (lines), and how much one event adds to a count: a repeated window has 2 x 3 words.
#: Plain chance repeats more of a long text than of a short one: repeats count in words x root of words.
PER, EVENT = (1000, 1000, 10000, 100, 100), (1, 1, 6, 1, 1)
#: Distance of the eighths of a count, in its standard deviations (those of the normal distribution).
NOISE = 2.3
#: The ranks, of 64, between which the widest step is sought, and the metrics that are counts of faults, which may be 0 in most texts.
TAIL, FAULTS = range(56, 65), 3
LEVELS = ("source", "language", "corpus")


@dataclass(frozen=True)
class QualityRules:
    """`fence`: spreads above the upper eighth that are still normal. `min_docs`: documents that a sketch needs
    to stand for its source or language."""

    min_words: int = 50
    max_repeat_percent: int = 50
    fence: int = 2
    min_docs: int = 200


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_BREAK), "")


def repeated_words(words: Column, size: int = 3) -> Column:
    """Words covered by `size`-word windows that occur twice or more.

    Windows are sorted as one long each (hash above, position below); equal neighbours are candidates,
    which a sort of the windows' real words confirms, so a hash collision costs time but no error.
    """

    def same(rows: Column, of) -> Column:
        return F.filter(
            rows,
            lambda v, k: F.coalesce(of(F.get(rows, k - 1)) == of(v), F.lit(False)) | F.coalesce(of(F.get(rows, k + 1)) == of(v), F.lit(False)),
        )

    def window(w: Column, i: Column) -> list[Column]:
        return [F.get(w, i + k) for k in range(size)]

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(size), F.coalesce(F.get(at, k + 1) - p, F.lit(size))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def of_words(w: Column) -> Column:
        starts = F.slice(w, 1, F.greatest(F.size(w) - (size - 1), F.lit(0)))
        packed = F.sort_array(
            F.transform(
                starts,
                lambda x, i: F.shiftleft(F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)]), POSITION_BITS).bitwiseOR(i.cast("long")),
            )
        )
        near = let(packed, lambda s: same(s, lambda v: F.shiftrightunsigned(v, POSITION_BITS)))
        places = F.transform(near, lambda v: v.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int"))
        exact = F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", *window(w, i)).alias("t"), i.alias("i"))))
        found = let(exact, lambda s: same(s, lambda v: v["t"]))
        return let(F.sort_array(F.transform(found, lambda v: v["i"])), covered)

    return let(words, of_words)


def quality_metrics(docs: DataFrame, text: str = "text") -> Column:
    """One struct of counts for a whole text (null: no words)."""

    def lines(t: Column) -> Column:
        return F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \t-\r]"))

    def of_text(t: Column) -> Column:
        return let(
            F.struct(words_of(t).alias("w"), lines(t).alias("l")),
            lambda a: F.struct(
                F.size(a["w"]).cast("long").alias("n_words"),
                F.length(F.array_join(a["w"], "")).cast("long").alias("word_chars"),
                (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
                (F.size(a["l"]) - F.size(F.array_distinct(a["l"]))).cast("long").alias("n_dup_lines"),
                repeated_words(a["w"]).alias("n_repeat_words"),
                F.size(a["l"]).cast("long").alias("n_lines"),
            ),
        )

    return let(F.coalesce(docs[text], F.lit("")), of_text)


def measures(docs: DataFrame, rules: QualityRules) -> Column:
    """Counts of a document's text, its base verdict, its group, and per metric the count, what it is of, and the rate."""

    def of_counts(c: Column) -> Column:
        counts = (c["n_symbols"], c["n_dup_lines"], c["n_repeat_words"], c["word_chars"], -c["word_chars"])
        bases = (c["n_words"], c["n_lines"], c["n_words"] * F.floor(F.sqrt(c["n_words"])).cast("long"), c["n_words"], c["n_words"])
        rate = lambda n, of, k: F.signum(n).cast("long") * F.floor(F.abs(n) * k / F.greatest(of, F.lit(1))).cast("long")
        return F.struct(
            *[c[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            ((c["n_words"] < rules.min_words) | (100 * c["n_repeat_words"] > rules.max_repeat_percent * c["n_words"])).alias("base_failed"),
            F.coalesce(docs["lang"], F.lit("")).alias("lang"),
            F.coalesce(docs["source"], F.lit("")).alias("source"),
            F.array(*[F.struct(n.alias("n"), of.alias("of"), rate(n, of, k).alias("rate")) for n, of, k in zip(counts, bases, PER)]).alias("metrics"),
        )

    return let(quality_metrics(docs), of_counts)


def bucket(v: Column) -> Column:
    """Lower edge of v's bucket: exact below 64, then 32 buckets per power of two; odd-symmetric below 0."""
    a = F.abs(v)
    shift = F.greatest(F.length(F.bin(a)) - 6, F.lit(0))
    edge = F.call_function("shiftleft", F.call_function("shiftright", a, shift), shift)
    return F.when(v < 0, -edge).otherwise(edge)


def width(edge: Column) -> Column:
    """Values of the bucket with this edge, less one."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(F.abs(edge))) - 6, F.lit(0))) - 1


def quantile_sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n) of `_q`. Sketches merge by adding n."""
    rows = measured.filter(~F.col("_q.base_failed")).select(F.col("_q.lang").alias("lang"), F.col("_q.source").alias("source"), F.posexplode("_q.metrics.rate").alias("metric", "v"))
    return rows.groupBy("lang", "source", "metric", bucket(F.col("v")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def eighths(sketch: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Keys, metric and a struct `name`: documents, upper eighth, distance of the eighths, and, where that is 0, the tail
    cutoff (else null). An eighth lies anywhere in its bucket, so the outer edges are taken."""
    group = Window.partitionBy(*keys, "metric")
    ranked = sketch.withColumn("below", F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(group))
    at = lambda k: F.min(F.when(64 * F.col("below") >= k * F.col("total"), F.col("bucket")))
    found = ranked.groupBy(*keys, "metric").agg(F.first("total").alias("docs"), at(8).alias("low"), at(56).alias("high"), F.array(*map(at, TAIL)).alias("tail"))
    low = F.col("low") - F.when(F.col("low") < 0, width(F.col("low"))).otherwise(0)
    high = F.col("high") + F.when(F.col("high") > 0, width(F.col("high"))).otherwise(0)
    flat = F.col("low") == F.col("high")
    return found.select(*keys, "metric", F.struct("docs", high.alias("high"), F.when(flat, 0).otherwise(high - low).alias("spread"), F.when(flat & (F.col("metric") < FAULTS), widest_step(F.col("tail"))).alias("tail")).alias(name))


def widest_step(values: Column) -> Column:
    """The middle of logarithms (of 1 + value) of the widest step between neighbours, the first of equal ones."""

    def step(k: Column) -> Column:
        a, b = (1 + F.get(values, x).cast("double") for x in (k, k + 1))
        return F.struct((b / a).alias("ratio"), (-k).alias("k"), (F.sqrt(a * b) - 1).alias("middle"))

    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(len(TAIL) - 2)), step))["middle"]


def cutoffs(sketch: DataFrame, rules: QualityRules) -> DataFrame:
    """One row per (lang, source): the level that measures it, and per metric that level's upper eighth, spread and tail cutoff."""
    own, lang, corpus = eighths(sketch, ["lang", "source"], "s"), eighths(merged(sketch, ["lang"]), ["lang"], "l"), eighths(merged(sketch, []), [], "c")
    fit = lambda c: F.col(f"{c}.docs") >= rules.min_docs
    by = lambda c: F.struct("metric", F.col(f"{c}.high").alias("high"), F.col(f"{c}.spread").alias("spread"), F.col(f"{c}.tail").alias("tail"))
    pick = lambda f: F.when(fit("s"), f("s", 0)).when(fit("l"), f("l", 1)).otherwise(f("c", 2))
    both = own.join(lang, ["lang", "metric"]).join(corpus, "metric")
    return both.groupBy("lang", "source").agg(F.sort_array(F.collect_list(pick(lambda c, k: by(c)))).alias("cuts"), F.first(pick(lambda c, k: F.lit(LEVELS[k]))).alias("level"))


def judged(measured: DataFrame, rules: QualityRules) -> DataFrame:
    """`measured` with `_kept` and `_level` (what measured it), by cutoffs from its own sketches."""
    sketch = written(quantile_sketch(measured), "sketch")
    cuts = written(cutoffs(sketch, rules), "cutoffs").select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "cuts", F.col("level").alias("_level"))

    def beyond(x: Column, i: Column) -> Column:
        k, event = F.get(F.array(*map(F.lit, PER)), i), F.get(F.array(*map(F.lit, EVENT)), i)
        m, cut = x["metrics"], x["cuts"]
        expected, spread = cut["high"] * m["of"] / k, cut["spread"] * m["of"] / k
        noise = NOISE * F.sqrt(event * F.greatest(F.abs(expected), event.cast("double")))
        in_tail = cut["tail"].isNull() | (m["rate"] > cut["tail"])
        return F.when(in_tail & (m["n"] > expected + rules.fence * F.greatest(spread, noise)), True).otherwise(False)

    over = F.exists(F.transform(F.arrays_zip(F.col("_q.metrics").alias("metrics"), "cuts"), beyond), lambda x: x)
    joined = measured.join(cuts, (F.col("_q.lang") == F.col("_lang")) & (F.col("_q.source") == F.col("_source")), "left")
    return joined.withColumn("_kept", ~F.col("_q.base_failed") & F.coalesce(~over, F.lit(False)))


def quality_verdicts(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Counts, base verdict and adaptive verdict for every document; `level` names the sketches that measured it.

    Defined cases: null or empty text has no words and fails the base rule; null lang or source form
    groups of their own (as ''); a group without a document past the base rule has no level (null); repeated
    rows are judged alike; an empty table gives an empty result; extra columns are ignored.
    """
    measured = written(docs.select("doc_id", measures(docs, rules).alias("_q")), "quality")
    return judged(measured, rules).select("doc_id", "_q.n_words", "_q.word_chars", "_q.n_symbols", "_q.n_dup_lines", "_q.n_repeat_words", "_q.base_failed", F.col("_kept").alias("kept"), F.col("_level").alias("level"))


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that pass, with their own columns. Texts are measured once: documents are written
    with their measures, which the sketches and the filter then read.

    Defined cases: as in `quality_verdicts`; repeated rows stay or go together; columns of any name stay as they are.
    """
    measured = written(docs.select(F.struct(*docs.columns).alias("_doc"), measures(docs, rules).alias("_q")), "quality")
    return judged(measured, rules).filter("_kept").select("_doc.*")
