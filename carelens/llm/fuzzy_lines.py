"""Fuzzy line dedup: near-equal lines of a corpus, one line kept per group.

Lines are compared in lower case without outer blanks, as sets of shingles of 8
characters (code points); a shorter line is its own only shingle. Equal lines are
merged first and signed once. Signature: the 20 smallest shingle hashes (bottom-k
MinHash). Bands are the 18 runs of three neighbours in that order: two lines of
Jaccard 0.8 keep some run in common with probability over 0.998, while lines that
only share frequent shingles hardly ever meet. Two sets of up to 20 elements and
Jaccard 0.8 always keep one, except for those of 4 and 5 elements: sets of up to 5
have the pairs of neighbours, too. In a bucket every line is compared with the
bucket's first line and with its predecessor by length. Buckets that still hold several
components are gone through again: all pairs of different components in those of up to
64 lines; lines of larger ones are placed anew by their rarest shingles
(``components.prefix_groups``), where any two similar ones meet, and compared until
every one has been compared or joined. Candidates are verified by exact Jaccard
similarity, and the links are joined up by distributed union-find (star
contraction). The first occurrence (smallest doc_id, then line number) of each
component stays, every other occurrence goes.

Built-in functions only. Edge cases: null and empty texts have no lines; blank
lines are kept and never compared; a document without doc_id is left whole and
is nobody's earlier occurrence; rows that repeat a doc_id are judged as one
document (a line that goes, goes from each); very long lines are compared whole.
A line is identified by a 64-bit hash of its compared form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carelens.llm.components import components, linked, prefix_groups
from carelens.llm.store import discard, stored

SHINGLE = 8
BLANKS = " \t\n\x0b\f\r"
#: Hashes of a signature.
BOTTOM = 20
#: Parts in which the lines are put into buckets, by bucket key, so that one part's exchange lies on disk at a time.
PASSES = 2
#: Lines whose hashes a task collects before it sorts them instead (by default 128): about 80 MB, by estimate.
KEYS = {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": 1 << 15}


def _form(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(BLANKS)))


def _wide(form: Column) -> Column:
    """The line in a form of fixed width, so that a shingle is a slice and not a search for its characters."""
    return F.encode(form, "UTF-32")


def _places(wide: Column) -> Column:
    """The byte, from 1, at which each shingle of a line begins."""
    return F.sequence(F.lit(1), F.greatest(F.octet_length(wide) - (4 * SHINGLE - 1), F.lit(1)), F.lit(4))


def _hash(wide: Column, place: Column) -> Column:
    return F.xxhash64(F.substring(wide, place, F.lit(4 * SHINGLE)))


def _shingles(form: Column) -> Column:
    """Hashes of a line's shingles. The line is bound to a lambda variable, so that it is encoded once."""
    return F.get(F.transform(F.array(_wide(form)), lambda w: F.transform(_places(w), lambda i: _hash(w, i))), 0)


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, a) of every line with a word."""
    return (docs.filter("doc_id IS NOT NULL")
            .select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
            .select("doc_id", "n", _form(F.col("line")).alias("form")).filter("form <> ''")
            .withColumn("a", F.xxhash64("form")))


def signed_forms(forms: DataFrame, factor: float = 1.6) -> tuple[DataFrame, DataFrame]:
    """Two tables (a, form, units, low, few), text, length and signature of every line form (a, form),
    and (a, units, low) of those with ``few``, whose signature in the first does not count.

    The smallest distinct hashes are looked for below ``factor`` times their
    expected bound, shingle by shingle; only lines for which that leaves too few are
    looked through without a bound. Forms that come grouped by ``a`` are signed where
    they are, without an exchange."""
    shingles = F.greatest(F.col("units") - SHINGLE + 1, F.lit(1))
    bound = (F.lit(-9.223372036854775e18) + F.lit(1.8446744073709552e19) * F.least(
        F.lit(factor * BOTTOM) / shingles, F.lit(1.0))).cast("long")
    low, few = F.sort_array(F.collect_set("h")), (F.size("low") <= BOTTOM) & (shingles > factor * BOTTOM)
    lines = forms.select("a", "form", F.char_length("form").alias("units"), _wide(F.col("form")).alias("w"))
    # the text goes with the first shingle, which is also there for lines that have none below the bound
    each = (lines.select("a", "units", "form", "w", bound.alias("bound"), F.explode(_places(F.col("w"))).alias("i"))
            .select("a", "units", "bound", "i", F.when(F.col("i") == 1, F.col("form")).alias("form"), _hash(F.col("w"), F.col("i")).alias("h"))
            .filter((F.col("h") < F.col("bound")) | (F.col("i") == 1)))
    sets = each.groupBy("a", "units").agg(F.first("form", ignorenulls=True).alias("form"), low.alias("low"))
    out = stored(sets.select("a", "form", "units", F.slice("low", 1, BOTTOM).alias("low"), few.alias("few")), KEYS)
    lines = out.filter("few").select("a", "units", _wide(F.col("form")).alias("w"))
    each = lines.select("a", "units", "w", F.explode(_places(F.col("w"))).alias("i")).select("a", "units", _hash(F.col("w"), F.col("i")).alias("h"))
    return out, stored(each.groupBy("a", "units").agg(F.slice(low, 1, BOTTOM).alias("low")))


def _similar(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (u, v) whose lines ``x`` and ``y`` have an exact Jaccard of the threshold or more."""
    p = pairs.select("u", "v", _shingles(F.col("x")).alias("x"), _shingles(F.col("y")).alias("y"))
    p = p.select("u", "v", F.size(F.array_intersect("x", "y")).alias("both"), F.size(F.array_union("x", "y")).alias("all"))
    return p.filter(F.col("both") >= threshold * F.col("all") - 1e-9).select("u", "v")


def _bands(signs: DataFrame) -> DataFrame:
    """(a, units, key): bucket keys of signatures: runs of three neighbours, of two in small sets.
    A run of three has the number of its first hash, shorter ones have numbers below 0."""
    n, i = F.size("low"), F.col("i")
    first = F.when(n > 5, F.lit(0)).otherwise(F.least(1 - n, F.lit(-1)))
    last = F.when(n < 5, F.lit(-1)).otherwise(n - 3)

    def run(place: Column, width: int) -> Column:
        return F.xxhash64(*[F.get("low", place + j) for j in range(width)])

    key = F.when(i >= 0, run(i, 3)).when(n == 1, run(F.lit(0), 1)).otherwise(run(i + n - 1, 2))
    return signs.select("a", "units", "low", F.explode(F.sequence(first, last, F.lit(1))).alias("i")).select("a", "units", key.alias("key"))


def line_groups(forms: DataFrame, threshold: float = 0.8, small: int = 64) -> DataFrame:
    """(a, root): the group of each line form (a, form) that is near another one.

    Candidates must share half of their smallest hashes; a third of them where all pairs of a
    bucket of at most ``small`` lines are compared."""
    parts = signed_forms(forms)
    signs = parts[0].filter("NOT few").select("a", "units", "low").unionByName(parts[1])
    bucket = Window.partitionBy("key").orderBy("units", "a")
    keys = _bands(signs)
    met = []
    for part in range(PASSES):
        of_part = keys.filter(F.pmod("key", F.lit(PASSES)) == part).select(
            "key", "a", F.first("a").over(bucket.rowsBetween(Window.unboundedPreceding, 0)).alias("head"), F.lag("a").over(bucket).alias("before"))
        met.append(stored(of_part.filter("head <> a")))
    met = reduce(DataFrame.unionByName, met)
    # from here on only lines that share a bucket count
    partners = stored(met.select(F.explode(F.array("a", "head")).alias("a")).distinct())
    lows = stored(signs.select("a", "low").join(partners, "a", "left_semi"))
    texts = stored(parts[0].select("a", "form").join(partners, "a", "left_semi"))
    discard(*parts, partners)

    def alike(pairs: DataFrame, share: int) -> DataFrame:
        """Pairs with one of ``share`` of their smallest hashes in common."""
        both = pairs.join(lows.select(F.col("a").alias("u"), F.col("low").alias("p")), "u").join(
            lows.select(F.col("a").alias("v"), F.col("low").alias("q")), "v")
        return both.filter(share * F.size(F.array_intersect("p", "q")) >= F.least(F.size("p"), F.size("q"))).select("u", "v")

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("a").alias("u"), F.col("form").alias("x")), "u").join(
            texts.select(F.col("a").alias("v"), F.col("form").alias("y")), "v")
        return _similar(both, threshold)

    def split(buckets: DataFrame, roots: DataFrame) -> DataFrame:
        """(key, a, root, members) of the buckets (key, a) of more than three lines that hold several
        components; in smaller ones all pairs have been compared."""
        placed = buckets.join(roots.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
        several = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members"))
        return placed.join(several.filter("low <> high AND members > 3").select("key", "members"), "key")

    pairs = stored(met.select("a", F.explode(F.array_distinct(F.array("head", "before"))).alias("b"))
                   .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    links = stored(verify(stored(alike(pairs, 2))))
    # in small buckets all pairs of lines of different components are compared
    roots = components(links)
    placed = stored(split(met.select("key", "a").unionByName(met.select("key", F.col("head").alias("a")).distinct()), roots))
    few = placed.filter(F.col("members") <= small)
    other = few.select("key", F.col("a").alias("b"), F.col("root").alias("root2"))
    met_there = few.join(other, "key").filter("a > b AND root <> root2").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
    more = stored(alike(met_there.join(pairs, ["u", "v"], "left_anti"), 3))
    pairs = pairs.unionByName(more)
    new = stored(verify(more))
    if not new.isEmpty():
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(new))
    # in larger ones, lines meet anew by their rarest shingles
    crowded = split(placed.filter(F.col("members") > small).select("key", "a"), roots).select("a").distinct()
    found = texts.join(crowded, "a", "left_semi").select("a", F.array_distinct(_shingles(F.col("form"))).alias("h"))
    tokens = stored(found.select(F.col("a").alias("node"), F.size("h").cast("long").alias("size"), F.explode("h").alias("token")))
    groups = stored(prefix_groups(tokens, threshold))
    discard(tokens)
    return linked(groups, verify, pairs, roots, threshold, 1).select(F.col("node").alias("a"), "root")


def removed_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_lines, removed): lines with a word and the line numbers to take
    out, for every document that has lines."""
    lines = _lines(docs)
    groups = line_groups(lines.groupBy("a").agg(F.first("form").alias("form")), threshold)
    lines = stored(lines.select("doc_id", "n", "a"))
    seen = lines.select("doc_id", "n", "a").join(groups, "a", "left").select(
        "doc_id", "n", F.coalesce("root", "a").alias("root"))
    first = seen.groupBy("root").agg(F.min("doc_id").alias("d"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    # the first line of the first document, from that document's own rows
    later = seen.join(first, "root")
    head = later.filter("doc_id = d").groupBy("root").agg(F.min("n").alias("m"))
    gone = later.join(head, "root").filter("NOT (doc_id = d AND n = m)")
    rows = lines.select("doc_id", "n", F.lit(None).cast("int").alias("gone")).unionByName(
        gone.select("doc_id", F.lit(None).cast("int").alias("n"), F.col("n").alias("gone")))
    return rows.groupBy("doc_id").agg(F.count("n").alias("n_lines"),
                                      F.array_sort(F.collect_set("gone")).alias("removed"))


def dedup_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """All columns of ``docs`` with ``text`` cut to the kept lines, and n_lines
    (lines with a word), n_removed, which take the place of columns of these names."""
    gone = removed_lines(docs, threshold).withColumnRenamed("doc_id", "__id")
    row = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").alias("__doc"))
    out = row.join(gone.select("__id", F.col("n_lines").alias("__lines"), F.col("removed").alias("__gone")),
                   F.col("__doc") == F.col("__id"), "left")
    some = F.coalesce(F.size("__gone"), F.lit(0)) > 0
    # the kept runs between removed lines: one slice each, so a text costs its length
    lines, edges = F.split(F.col("__row.text"), "\n", -1), F.array_union(F.array(F.lit(-1)), F.col("__gone"))
    cut = F.get(F.transform(F.array(F.struct(lines.alias("all"), F.concat(edges, F.array(F.size(lines))).alias("at"))), lambda x: F.array_join(
        F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["at"]) - 2), lambda i: F.slice(
            x["all"], F.get(x["at"], i) + 2, F.get(x["at"], i + 1) - F.get(x["at"], i) - 1))), "\n")), 0)
    return out.select(*[F.when(some, cut).otherwise(F.col("__row.text")).alias(c) if c == "text" else F.col(f"__row.{_quoted(c)}").alias(c)
                        for c in docs.columns if c not in ("n_lines", "n_removed")],
                      F.coalesce("__lines", F.lit(0)).cast("long").alias("n_lines"),
                      F.when(some, F.size("__gone")).otherwise(0).cast("long").alias("n_removed"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
