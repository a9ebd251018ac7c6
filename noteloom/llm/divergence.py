"""Audit of how far the sources of a language diverge in their words.

Every source of a language gives every kept term a smoothed share ``p`` in
billionths, and two sources differ by the sum over all kept terms of
``f(p, q) = floor((p - q)^2 / (p + q))``. Most sources lack most terms, so the sum
isn't taken term by term but by inclusion and exclusion over the supports A and B
of two sources, with ``z`` the share of a term that doesn't occur:

    sum over A of f(p, z_B)  +  sum over B of f(z_A, q)
    + sum over the terms in both of  f(p, q) - f(p, z_B) - f(z_A, q) + f(z_A, z_B)
    + (V - |A| - |B|) f(z_A, z_B)

The first two need only how many terms of a source occur how often (its count
histogram), priced once for each distinct ``z``; the third is a join of the sparse
postings on their term; the last is a constant. All numbers are integers.

Texts are counted where they lie: a task adds up its terms by language and source
within a bounded dictionary, and only sums are shuffled, once, by term. Joins by
language alone are salted.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.word_ids import batches_by_size
from noteloom.runtime import Scratch, ship

#: A term is kept if this many documents of its language hold it.
LEAST_DOCS = 10
RANKS = 10
SCALE = 1_000_000_000
#: Parts that rows of one language are dealt into where they are joined by language.
SALTS = 32
#: (group, term) sums that a task holds before it sends them on.
MOST_SUMS = 200_000
GROUP_CHARS = 2 << 20

#: ASCII signs but letters become spaces, capitals small letters; bytes of other characters stay.
_BYTES = bytes(32 if b < 128 and not chr(b).isalpha() else ord(chr(b).lower()) if b < 128 else b for b in range(256))

_SUMS = "lang string, source string, term string, n long, docs long"
_SUMS_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms_of(text: str) -> list[bytes]:
    """Runs of ASCII letters, in lower case, and of characters beyond ASCII."""
    return text.encode().translate(_BYTES).split()


def _sums(batches):
    """Occurrences and documents of each term by language and source; the empty term stands for the group itself."""
    held: dict = {}

    def flush():
        rows = [(lang, source, term.decode(), n, docs[term]) for (lang, source), (count, docs) in held.items() for term, n in count.items()]
        rows += [(lang, source, "", 0, 0) for lang, source in held]
        held.clear()
        for i in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[i : i + 50_000]), _SUMS_ARROW)], schema=_SUMS_ARROW)

    for batch in batches:
        for rows in batches_by_size(zip(*(c.to_pylist() for c in batch.columns)), lambda r: len(r[2]), GROUP_CHARS):
            for lang, source, text in rows:
                own = Counter(terms_of(text))
                count, docs = held.setdefault((lang, source), (Counter(), Counter()))
                count.update(own)
                docs.update(own.keys())
            if sum(len(count) + 1 for count, _ in held.values()) >= MOST_SUMS:
                yield from flush()
    yield from flush()


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (n + 2) / (total + 2 kept)); in decimals, as a frequent term exceeds 9e9 occurrences in a large corpus."""
    of = (total + 2 * kept).cast("decimal(20,0)")
    quotient = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)"), of)
    return F.when(kept > 0, quotient + 1).otherwise(F.lit(0).cast("long"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of shares; 0 of two zeros."""
    return F.when(p + q > 0, F.call_function("div", (p - q) * (p - q), p + q)).otherwise(F.lit(0).cast("long"))


def term_counts(docs: DataFrame, scratch: Scratch, lang_col: str, source_col: str, text_col: str, least_docs: int) -> DataFrame:
    """Kept terms by group: lang, source, term, n, lang_n (occurrences in the language), lead (one row of each term); a row with term '' for each group."""
    some = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    sums = some.mapInArrow(_sums, _SUMS).repartition("lang", "term")
    by_group = sums.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    wide = by_group.select("*", F.sum("docs").over(term).alias("held"), F.sum("n").over(term).alias("lang_n"), F.min("source").over(term).alias("least"))
    kept = wide.filter((F.col("held") >= least_docs) | (F.col("term") == ""))
    return scratch.write(kept.select("lang", "source", "term", "n", "lang_n", ((F.col("source") == F.col("least")) & (F.col("term") != "")).alias("lead")), "terms")


def source_divergence(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, ranks: int = RANKS
) -> DataFrame:
    """How sources of a language differ: lang, source, part, item, value, rank.

    Part ``pair``: each other source of the language and the divergence from it, all
    ranks. Part ``term``: the kept terms that the source uses more than its language
    does, with what each adds to its divergence from the language, up to ``ranks``.
    Ranks go by value, falling, then by the item's UTF-8 bytes.

    A null language, source or text counts as ''. Every group of language and source
    that occurs has its rows of part ``pair``, without terms too; where no term is
    kept all values are 0. Repeated rows and ids count as often as they occur. Ties
    are broken by item. A text of any length is read whole. An empty table gives an
    empty result. Other columns, whatever their names, aren't read.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "divergence")
    counts = term_counts(docs, scratch, lang_col, source_col, text_col, least_docs)
    there = F.col("term") != ""
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(there.cast("long")).alias("own"), F.sum(F.col("lead").cast("long")).alias("led"))
    lang = Window.partitionBy("lang")  # as many rows as there are sources
    groups = groups.select("lang", "source", "total", "own", F.sum("led").over(lang).alias("kept"), F.sum("total").over(lang).alias("lang_total"))
    none = F.lit(0).cast("long")
    groups = scratch.write(groups.withColumn("z", share(none, F.col("total"), F.col("kept"))), "groups")

    priced = counts.filter(there).join(groups, ["lang", "source"])
    priced = priced.select("lang", "source", "term", "n", "z", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"))
    priced = scratch.write(priced, "priced")

    result = pair_values(priced, groups)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = result.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    ahead = priced.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    # the limit on ranks reaches the map side, so that no task sorts a whole source
    best = ahead.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)
    return pairs.unionByName(best)


def pair_values(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for both directions of every pair of sources of a language."""
    salt = F.pmod(F.xxhash64("source", "p"), F.lit(SALTS))
    # how many terms of a source have which share; a row without terms for each source, so that none is missing
    histogram = priced.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("terms"))
    histogram = histogram.unionByName(groups.select("lang", "source", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("terms"))).withColumn("salt", salt)
    zeros = groups.select("lang", F.col("z").alias("other_z")).distinct().select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    one_sided = histogram.join(zeros, ["lang", "salt"]).groupBy("lang", "source", "other_z").agg(F.sum(F.col("terms") * gap(F.col("p"), F.col("other_z"))).alias("priced"))

    mine = groups.select("lang", "source", F.col("z").alias("mine_z"), F.col("own").alias("mine_own"), "kept")
    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("other_z"), F.col("own").alias("other_own"))
    sided = one_sided.join(mine, ["lang", "source"]).join(other, ["lang", "other_z"]).filter("source <> item")
    constant = (F.col("kept") - F.col("mine_own") - F.col("other_own")) * gap(F.col("mine_z"), F.col("other_z"))
    x, y = F.least("source", "item").alias("x"), F.greatest("source", "item").alias("y")
    part = F.col("priced") + F.when(F.col("source") < F.col("item"), constant).otherwise(F.lit(0).cast("long"))

    a, b = (priced.select("lang", "term", F.col("source").alias(s), F.col("p").alias(f"{s}_p"), F.col("z").alias(f"{s}_z")) for s in ("x", "y"))
    both = a.join(b, ["lang", "term"]).filter("x < y")
    p, q, zp, zq = (F.col(c) for c in ("x_p", "y_p", "x_z", "y_z"))
    overlap = both.groupBy("lang", "x", "y").agg(F.sum(gap(p, q) - gap(p, zq) - gap(zp, q) + gap(zp, zq)).alias("part"))

    total = sided.select("lang", x, y, part.alias("part")).unionByName(overlap).groupBy("lang", "x", "y").agg(F.sum("part").alias("value"))
    either = F.inline(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item"))))
    return total.select("lang", "value", either)
