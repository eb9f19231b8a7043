"""Line-first cleaning: rules judge lines, then documents by what they lost.

Each ``\\n``-separated line is tested on its own: it must read like prose (hold
a sentence mark at the end of some word), and must not be navigation (separator-heavy), symbol
noise, shouting, one word over and over, or a boilerplate notice. Failing lines
are removed; a document that loses more than ``max_loss`` of its words is
rejected, as is one that fails the base rules (too short, or too many words in
repeated 5-word windows).

Only built-in functions over the row's own text: no shuffle, no Python. Counts
of single ASCII characters are byte-length differences of ``replace``.

Edge cases: a null or empty text has no words and fails the base rules; lines
without a word are neither kept nor lost; texts of any length are judged whole;
rows that repeat a doc_id are judged each for itself; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|<>"
#: Marks that end a sentence, and phrases of notices.
SENTENCE = r"[.!?…。！？؟।](\s|[\"'”’)\]]|$)"
BOILERPLATE = ("cookie", "privacy policy", "terms of use", "terms of service", "all rights reserved",
               "javascript", "lorem ipsum", "click here", "sign up", "log in", "subscribe to", "copyright ©",
               "licensed under", "permission is hereby granted", "without warranty")


def _count(text: Column, chars: str) -> Column:
    """Occurrences of some ASCII characters."""
    return reduce(lambda a, b: a + b, [
        F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars])


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _judge(x: Column, p: dict) -> Column:
    """(line, number of words, ok) of one line given as (line, bare, words)."""
    line, bare, words = x["line"], x["bare"], x["words"]
    n, low = F.size(words), F.lower(bare)
    fails = (~bare.rlike(SENTENCE)
             | (_count(line, SEPARATORS) > p["max_separators"] * n)
             | (_count(line, SYMBOLS) > p["max_symbols"] * n)
             | ((n >= p["shout_words"]) & (low != bare) & (F.upper(bare) == bare))
             | ((n >= p["dull_words"]) & (F.size(F.array_distinct(words)) < p["min_distinct"] * n))
             | reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in BOILERPLATE]))
    return F.struct(line.alias("line"), n.alias("n"), (~fails).alias("ok"))


def line_rules(docs: DataFrame, max_loss: float = 0.5, max_symbols: float = 0.1, max_separators: float = 0.1,
               shout_words: int = 3, dull_words: int = 20, min_distinct: float = 0.2,
               min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_lines, n_lines_removed, n_words_removed, text): one row
    per document; ``text`` is the document without its failing lines."""
    p = dict(max_symbols=max_symbols, max_separators=max_separators, shout_words=shout_words,
             dull_words=dull_words, min_distinct=min_distinct)
    text = F.col("raw")
    df = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("raw"))
    df = df.select("*", F.filter(F.transform(
        F.split(text, "\n", -1), lambda x: F.struct(x.alias("line"), _strip(x).alias("bare"))),
        lambda x: x["bare"] != "").alias("bared"))
    df = df.select("doc_id", "raw", F.transform("bared", lambda x: F.struct(
        x["line"].alias("line"), x["bare"].alias("bare"), F.split(x["bare"], "[ \\t-\\r]+").alias("words"))).alias("rows"))
    df = df.select("*", F.flatten(F.col("rows.words")).alias("w"), F.col("rows.line").alias("lines"))
    df = df.select("*", F.when(F.size("w") >= 5, F.transform(
        F.sequence(F.lit(0), F.size("w") - 5),
        lambda i: F.xxhash64(*[F.get(F.col("w"), i + j) for j in range(5)])))
        .otherwise(F.array().cast("array<bigint>")).alias("h"))
    # sorted (hash, position) pairs, only where some window occurs twice
    df = df.select("*", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(
        F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("pairs"))
    df = df.select("*", F.sort_array(F.transform(
        F.filter("pairs", lambda q, j: F.coalesce(
            (F.get(F.col("pairs"), j - 1)["x"] == q["x"]), F.lit(False))
            | F.coalesce(F.get(F.col("pairs"), j + 1)["x"] == q["x"], F.lit(False))),
        lambda q: q["i"])).alias("at"),
        F.transform("rows", lambda x: _judge(x, p)).alias("judged"))
    covered = F.coalesce(F.aggregate(F.transform("at", lambda x, j: F.least(
        F.lit(5), F.coalesce(F.get(F.col("at"), j + 1) - x, F.lit(5)))), F.lit(0), lambda a, b: a + b), F.lit(0))
    ok = F.filter("judged", lambda x: x["ok"])
    add = lambda rows: F.aggregate(rows, F.lit(0), lambda a, x: a + x["n"])
    df = df.select(
        "doc_id", F.size("w").cast("long").alias("n_words"),
        (F.char_length(text) - _count(text, BLANKS)).cast("long").alias("word_chars"),
        _count(text, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), F.size(ok).cast("long").alias("n_ok"),
        add(ok).cast("long").alias("n_kept"), F.array_join(F.transform(ok, lambda x: x["line"]), "\n").alias("text"))
    df = df.withColumn("base_failed", (F.col("n_words") < min_words)
                       | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("n_kept") >= (1 - max_loss) * F.col("n_words"))).alias("kept"),
        "n_lines", (F.col("n_lines") - F.col("n_ok")).alias("n_lines_removed"),
        (F.col("n_words") - F.col("n_kept")).alias("n_words_removed"), "text")
