"""Which texts hold which patterns, for many patterns at once, case aside.

A join on ``contains`` has no key and would compare every text with every pattern.
Here every pattern gets a key: a stretch of a few characters (a gram) that any text
holding the pattern must hold too. Of its grams it takes the one that the fewest
texts have, so that a pattern of common words isn't tried on every text that has
one of them; a pattern with a gram that no text has is done with. Texts and patterns
that share a key are compared in full.

Grams begin where words do, so that a text gives as many as it has words. A pattern
without such a gram inside (one word, a script without spaces) takes grams at every
place; texts give these only if there are such patterns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.runtime import Scratch, fresh_name, numbered, quoted

#: Characters of a gram at the beginning of a word, and of one at any place.
WORD_GRAM, ANY_GRAM = 12, 4

_LETTER = r"[\p{L}\p{N}]"


@dataclass(frozen=True)
class Grams:
    """A kind of gram: ``of_pattern`` finds those that stand in a pattern with what makes them one, so that ``of_text`` finds them in any text that holds it."""

    name: str
    of_pattern: str
    of_text: str


def kinds() -> list[Grams]:
    """From the best kind: a pattern takes the first of which it has a gram."""
    word = rf"(?=({_LETTER}.{{{WORD_GRAM - 1}}}))"
    out = [Grams("word", rf"(?s)(?<=[^\p{{L}}\p{{N}}]){word}", rf"(?s)(?<!{_LETTER}){word}")]
    return out + [Grams(f"any{n}", rf"(?s)(?=(.{{{n}}}))", rf"(?s)(?=(.{{{n}}}))") for n in range(ANY_GRAM, 0, -1)]


def grams(text: Column, pattern: str) -> Column:
    """Hashes of a text's grams, each once: two grams of one hash make a text be compared in vain, no more."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda g: F.xxhash64(g)))


def contained(
    docs: DataFrame, patterns: DataFrame, text: str = "text", pattern: str = "text", carry: dict[str, str] | None = None, carry_pattern: dict[str, str] | None = None
) -> DataFrame:
    """A row for each row of ``docs`` and each row of ``patterns`` whose text it holds, both in lower case.

    carry, carry_pattern: columns to return, old name to new, of either side; new names
    are plain and differ. A null
    text holds nothing; null and empty patterns are held by nothing here. Repeated
    rows on either side give a row each. Texts are read whole, however long. Empty
    tables give no rows. Other columns, whatever their names, aren't read.
    """
    scratch = Scratch(docs.sparkSession, "contains")
    carry, carry_pattern = carry or {}, carry_pattern or {}
    uid = fresh_name(docs, "__uid")
    rows = numbered(docs.filter(F.col(quoted(text)).isNotNull()), scratch, uid)
    rows = rows.select(F.col(uid).alias("__uid"), lowered(text).alias("__low"), *[F.col(quoted(a)).alias(b) for a, b in carry.items()])
    owners = patterns.select(lowered(pattern).alias("__pattern"), *[F.col(quoted(a)).alias(b) for a, b in carry_pattern.items()]).filter("__pattern <> ''")
    owners = scratch.write(owners.withColumn("__pid", F.sha2("__pattern", 256)), "owners")
    wanted = scratch.write(owners.select(F.col("__pid").alias("pid"), F.col("__pattern").alias("pattern")).distinct(), "patterns")
    keys = pattern_keys(rows.select(F.col("__uid").alias("uid"), F.col("__low").alias("low")), wanted, scratch)
    # only texts with a key of some pattern go on, and only their ids are dealt by key
    pairs = scratch.write(keys.join(wanted, "pid").select("uid", "pid", "pattern"), "candidates")
    found = rows.join(pairs, F.col("__uid") == F.col("uid")).filter(F.contains(F.col("__low"), F.col("pattern"))).select("pid", *carry.values())
    return found.join(owners.drop("__pattern"), F.col("pid") == F.col("__pid")).select(*carry.values(), *carry_pattern.values())


def lowered(name: str) -> Column:
    return F.lower(F.col(quoted(name)).cast("string"))


def pattern_keys(texts: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(uid, pid): texts (uid, low) and patterns (pid, pattern) that share the pattern's key."""
    chosen = F.coalesce(*[F.when(F.size(grams(F.col("pattern"), k.of_pattern)) > 0, F.lit(k.name)) for k in kinds()])
    sorted_ = scratch.write(wanted.select("pid", "pattern", chosen.alias("kind")), "kinds")
    there = {r.kind for r in sorted_.select("kind").distinct().collect()}  # of five
    out = None
    for k in kinds():
        if k.name not in there:
            continue
        of_pattern = sorted_.filter(F.col("kind") == k.name).select("pid", F.explode(grams(F.col("pattern"), k.of_pattern)).alias("gram"))
        of_pattern = scratch.write(of_pattern, f"grams_{k.name}")
        known = of_pattern.select("gram").distinct()
        hits = scratch.write(texts.select("uid", F.explode(grams(F.col("low"), k.of_text)).alias("gram")).join(known, "gram", "left_semi"), f"hits_{k.name}")
        often = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        rare = of_pattern.join(often, "gram", "left").select("pid", F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "gram").alias("key"))
        keys = scratch.write(rare.groupBy("pid").agg(F.min("key").alias("key")).filter("key.n > 0").select("pid", "key.gram"), f"keys_{k.name}")
        pairs = hits.join(keys, "gram").select("uid", "pid")
        out = pairs if out is None else out.unionByName(pairs)
    return out if out is not None else texts.sparkSession.createDataFrame([], "uid long, pid string")
