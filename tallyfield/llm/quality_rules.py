"""Quality rules with adaptive thresholds; DataFrame functions only.

Counts of each text are made by column expressions.  For each (lang, source) group and each signal a
mergeable quantile sketch is built over all the group's documents with words: a histogram over bins of
equal ratio (one part in a hundred), whose counts add up, so that groups merge into languages and these
into all, and a rerun gives the same.  What is sketched of a count is the highest rate that the document
leaves possible, ``NOISE`` deviations of a count above its own: a short text without a sign says little,
a long one much.  A group's threshold is its upper quartile and ``RATE_FENCE`` times the quartiles'
distance more, so it is a rate, follows the group's lengths and habits, and is never a number of signs.  A
document is rejected if even the lowest rate that its count leaves possible lies above.  Lengths of words
are sketched as they are and may lie outside on either side.  Groups of fewer than ``LEAST`` documents take
the merged sketch of their language, languages of fewer the merged sketch of all.  The thresholds, a few
numbers for each group, are joined back to the documents by group.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window, functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
#: Distances of the quartiles beyond which a length, or a rate, is outside.
FENCE, RATE_FENCE = 3.0, 1.5
NOISE = 2.0
#: Neighbouring bins of a sketch differ by this ratio.
RATIO = 1.01
LEAST = 100
WINDOW = 5


def text_counts(text: Column) -> dict[str, Column]:
    """Building blocks: words (array), lines with a word (array)."""
    t = F.coalesce(text, F.lit(""))
    return {"words": F.filter(F.split(t, SPACE), lambda w: w != ""), "lines": F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]")))}


def bind(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), 0)


def covered(runs: Column) -> Column:
    """From the hashes of all five-word windows to the number of words in windows found twice or more."""

    def places(tagged: Column) -> Column:
        return F.transform(F.filter(tagged, lambda t, i: F.coalesce(F.when(i > 0, F.get(tagged, i - 1)["x"] == t["x"]), F.lit(False)) | F.coalesce(F.get(tagged, i + 1)["x"] == t["x"], F.lit(False))), lambda t: t["i"])

    at = F.array_sort(bind(F.array_sort(F.transform(runs, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), places))
    return F.aggregate(at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")), lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")))["n"]


def rule_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Null texts count as empty.  Only doc_id, text, lang and source are read.
    """
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), t.alias("t"))
    parts = text_counts(F.col("t"))
    chars = F.length(F.regexp_replace("t", SPACE, "")).cast("long")
    symbols = (F.size(F.split("t", "[#*$%&|<>]")) - 1).cast("long")
    d = d.select("doc_id", "lang", "source", parts["words"].alias("w"), parts["lines"].alias("lines"), chars.alias("word_chars"), symbols.alias("n_symbols"))
    d = d.select("doc_id", "lang", "source", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    runs = F.when(F.size("h") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("h"), i + j) for j in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("runs", runs).drop("h")
    repeats = F.when(F.size(F.array_distinct("runs")) == F.size("runs"), F.lit(0).cast("long")).otherwise(covered(F.col("runs")))
    return d.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeats.alias("n_repeat_words"))


def signals() -> dict[str, tuple[Column, Column, Column | None]]:
    """Signal -> (what is sketched, what must not lie above the group's, what must not lie below, if any).

    Words in repeated windows come ten at a time, two windows of five; lengths of words spread by about
    half their mean.
    """
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lumps = {"symbols": ("n_symbols", 1.0), "dup_lines": ("n_dup_lines", 1.0), "repeats": ("n_repeat_words", 2.0 * WINDOW)}
    out = {}
    for name, (c, lump) in lumps.items():
        spread = NOISE * F.sqrt(F.col(c) * lump)
        out[name] = (F.col(c) + spread + NOISE * NOISE * lump) / n, (F.col(c) - spread) / n, None
    length = F.col("word_chars") / n
    chance = NOISE * 0.5 * length / F.sqrt(n)
    return out | {"word_chars": (length, length - chance, length + chance)}


def sketches(counts: DataFrame) -> DataFrame:
    """lang, source, signal, bin, n: the groups' sketches, a count for each bin that has any."""
    of = lambda v: F.round(F.log(v) / log(RATIO)).cast("int")
    each = F.array(*[F.struct(F.lit(s).alias("signal"), of(v).alias("bin")) for s, (v, _, _) in signals().items()])
    return counts.where("n_words > 0").select("lang", "source", F.inline(each)).groupBy("lang", "source", "signal", "bin").agg(F.count("*").alias("n"))


def quartiles(sketched: DataFrame, *by: str) -> DataFrame:
    """by, k (documents) and of each signal the quartiles q1_.. and q3_.. of the sketches, merged by these columns."""
    bins = sketched.groupBy(*by, "signal", "bin").agg(F.sum("n").alias("n"))
    # a sketch has as many bins as its values have hundredths, whatever the documents
    upto = F.sum("n").over(Window.partitionBy(*by, "signal").orderBy("bin"))
    placed = bins.withColumns({"upto": upto, "k": F.sum("n").over(Window.partitionBy(*by, "signal"))})
    at = lambda s, q: F.min(F.when((F.col("signal") == s) & (F.col("upto") >= q * F.col("k")), F.pow(F.lit(RATIO), F.col("bin"))))
    return placed.groupBy(*by).agg(F.max("k").alias("k"), *[at(s, q).alias(f"{name}_{s}") for s in signals() for name, q in (("q1", 0.25), ("q3", 0.75))])


def thresholds(counts: DataFrame) -> DataFrame:
    """of_lang, of_source and of each signal the least and greatest usual value, from the group's sketches."""
    from tallyfield.llm.common import stash

    sketched = stash(sketches(counts))
    groups = counts.select("lang", "source").distinct().withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    named = lambda rows, tag: rows.select([F.col(c).alias(f"{tag}_{c}") for c in rows.columns])
    own, tongue, all_ = named(quartiles(sketched, "lang", "source"), "own"), named(quartiles(sketched, "lang"), "tongue"), named(quartiles(sketched), "all")
    told = groups.join(own, F.col("of_lang").eqNullSafe(F.col("own_lang")) & F.col("of_source").eqNullSafe(F.col("own_source")), "left")
    told = told.join(tongue, F.col("of_lang").eqNullSafe(F.col("tongue_lang")), "left").crossJoin(F.broadcast(all_))  # one row
    out = []
    for s, (_, _, below) in signals().items():
        pick = lambda q, s=s: F.when(F.col("own_k") >= LEAST, F.col(f"own_{q}_{s}")).when(F.col("tongue_k") >= LEAST, F.col(f"tongue_{q}_{s}")).otherwise(F.col(f"all_{q}_{s}"))
        q1, q3 = pick("q1"), pick("q3")
        out.append((q3 + (RATE_FENCE if below is None else FENCE) * (q3 - q1)).alias(f"high_{s}"))
        if below is not None:
            out.append((q1 - FENCE * (q3 - q1)).alias(f"low_{s}"))
    return told.where("all_k > 0").select("of_lang", "of_source", *out)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, kept for each row of ``docs``.

    base_failed: under 10 words, or more than a fifth of the words in repeated five-word windows.
    kept: not base_failed and every signal within the thresholds of the row's (lang, source), by the
    lowest rate that its count leaves possible; nulls form a group like any value.  Repeated rows are judged each; an empty
    table gives no rows.
    """
    from tallyfield.llm.common import stash

    counts = stash(rule_counts(docs))
    limits = stash(thresholds(counts))
    joined = counts.join(limits, counts["lang"].eqNullSafe(F.col("of_lang")) & counts["source"].eqNullSafe(F.col("of_source")), "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    within = F.lit(True)
    for s, (_, above, below) in signals().items():
        within = within & (above <= F.col(f"high_{s}"))
        if below is not None:
            within = within & (below >= F.col(f"low_{s}"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.coalesce(within, F.lit(True))).alias("kept"))
