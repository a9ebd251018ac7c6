"""Merkle manifest of a table, with a proof of membership for every row.

A row's leaf is the digest of its values; the leaves of a source, by id, are folded
16 at a time until its subroot is left, and the subroots, by source, until the root
is. Indices are bucketed by 16^k: one ``applyInPandas`` call collapses k levels of a
bucket of at most 16^k nodes, and the roots of buckets are reduced by the same
step, so that no task holds a source and a tree of any height takes a few rounds.

Proofs are put together on the way back: a bucket's own proof is the upper part of
the proofs of all its nodes, and joins their lower parts in the task that works
these out. So proofs of documents, which are longer than their leaves, never
travel; only those of buckets do.

Leaves are put in order by a range partitioning over (source, id, leaf), which cuts
a hot source into many ranges; a row's place is its place in its range and a prefix
sum over the ranges.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.ordering import ordered
from noteloom.runtime import Scratch, ship

FANOUT = 16
#: Levels that one call collapses: buckets of 256 nodes.
LEVELS = 2


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def runs(nodes: list[str], fanout: int) -> list[str]:
    """Parents of a level's nodes: the digest of every ``fanout`` consecutive ones."""
    return [digest(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]


def collapsed(nodes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes and all levels above them."""
    out = [nodes]
    for _ in range(levels):
        out.append(runs(out[-1], fanout))
    return out


def path(tree: list[list[str]], i: int, fanout: int) -> list[str]:
    """Siblings of node i and of the nodes above it, level by level: those before it as one text, then those after it."""
    out = []
    for level in tree[:-1]:
        first = i - i % fanout
        out += ["".join(level[first:i]), "".join(level[i + 1 : first + fanout])]
        i //= fanout
    return out


def fold(node: str, proof: list[str]) -> str:
    """The root that a node and its siblings give."""
    for before, after in zip(proof[::2], proof[1::2]):
        node = digest(before, node, after)
    return node


def sized(c: Column) -> Column:
    """A value as a leaf holds it: its byte count, a colon and its UTF-8 text; ``-`` if null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def height(n: Column, fanout: int, most: int) -> Column:
    """Levels over n nodes, ``most`` at most."""
    return sum((F.when(n > fanout**i, 1).otherwise(0) for i in range(most)), F.lit(0))


class Tree:
    """Nodes (grp, idx, n, node) of many groups and the reductions over them; grp may be null."""

    def __init__(self, nodes: DataFrame, scratch: Scratch, name: str, fanout: int = FANOUT, levels: int = LEVELS):
        self.scratch, self.name, self.fanout, self.levels = scratch, name, fanout, levels
        self.rounds = [nodes]
        span = fanout**levels
        while (most := self.rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
            now = self.rounds[-1]
            up = F.when(F.col("n") > 1, F.floor(F.col("idx") / span)).otherwise(F.col("idx"))
            made = now.withColumns({"bucket": up, "height": height(F.col("n"), fanout, levels)}).groupBy("grp", "bucket").applyInPandas(_root(fanout), "grp string, idx long, n long, node string")
            self.rounds.append(scratch.write(made.select("grp", "idx", F.ceil(F.col("n") / span).alias("n"), "node"), f"{name}_up{len(self.rounds)}"))
            if most <= span:
                break

    def roots(self) -> DataFrame:
        return self.rounds[-1].select("grp", "node")

    def proofs(self, above: DataFrame, extra: list[str]) -> tuple[DataFrame, DataFrame]:
        """(the lowest nodes, the proofs of their buckets), from those of the roots: ``above`` has grp, idx, proof and the columns ``extra`` (strings)."""
        span = self.fanout**self.levels
        kinds = ", ".join(f"{c} string" for c in extra)
        for k in range(len(self.rounds) - 2, 0, -1):
            lower = self.rounds[k].withColumns({"bucket": F.floor(F.col("idx") / span), "height": height(F.col("n"), self.fanout, self.levels)})
            upper = above.withColumnRenamed("idx", "bucket")
            joined = lower.groupBy("grp", "bucket").cogroup(upper.groupBy("grp", "bucket")).applyInPandas(_proofs(self.fanout, extra), f"grp string, idx long, proof array<string>, {kinds}")
            above = self.scratch.write(joined, f"{self.name}_down{k}")
        lowest = self.rounds[0].withColumns({"bucket": F.floor(F.col("idx") / span), "height": height(F.col("n"), self.fanout, self.levels)})
        return lowest, above.withColumnRenamed("idx", "bucket")


def _root(fanout: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        tree = collapsed(list(pdf["node"]), int(pdf["height"].iloc[0]), fanout)
        first = pdf.iloc[0]
        return pd.DataFrame({"grp": [first["grp"]], "idx": [first["bucket"]], "n": [first["n"]], "node": [tree[-1][0]]})

    return run


def _proofs(fanout: int, extra: list[str]):
    def run(lower: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        lower, up = lower.sort_values("idx"), upper.iloc[0]
        tree = collapsed(list(lower["node"]), int(lower["height"].iloc[0]), fanout)
        rest = list(up["proof"])
        proofs = [path(tree, i, fanout) + rest for i in range(len(lower))]
        return pd.DataFrame({"grp": lower["grp"].to_numpy(), "idx": lower["idx"].to_numpy(), "proof": proofs} | {c: [up[c]] * len(lower) for c in extra})

    return run


_OUT = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _verify(fanout: int, with_proof: bool):
    def run(lower: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        lower, up = lower.sort_values("idx"), upper.iloc[0]
        leaves = list(lower["node"])
        tree = collapsed(leaves, int(lower["height"].iloc[0]), fanout)
        rest, root = list(up["proof"]), up["root"]
        proofs = [path(tree, i, fanout) + rest for i in range(len(leaves))]
        folded = [fold(found or leaf, proof) for leaf, found, proof in zip(leaves, lower["found"], proofs)]
        out = {
            "doc_id": lower["doc_id"].to_numpy(),
            "leaf": leaves,
            "subroot": up["subroot"],
            "root": root,
            "proof_sha256": [digest(*p) for p in proofs],
            "folded_root": folded,
            "verified": [f == root for f in folded],
        }
        return pd.DataFrame(out | ({"proof": proofs} if with_proof else {}))

    return run


def merkle_manifest(
    docs: DataFrame,
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    group: str = "source",
    order: str = "doc_id",
    changed: dict[str, Column] | None = None,
    fanout: int = FANOUT,
    levels: int = LEVELS,
    with_proof: bool = False,
) -> DataFrame:
    """Leaf, subroot, root and checked proof of every row.

    A leaf is the SHA-256 of ``columns``, each as :func:`sized` writes it. Returns
    doc_id (``order``), leaf, subroot, root, proof_sha256 (of all siblings, in order),
    folded_root (what the row as it is found now and the siblings of the manifest
    give) and verified (whether that is the root); with ``with_proof`` also proof,
    level by level the siblings before and after the node. ``changed`` names columns
    that are found otherwise than the manifest has them.

    Nulls have a form of their own (``-``), so an empty text and a null differ; a
    null ``group`` is a group, before all others. Rows with equal ids are ordered by
    leaf; equal rows get equal results. A text of any length is digested in place,
    and only digests are shuffled. An empty table gives an empty result. Columns
    other than those named aren't read, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "merkle")
    changed = changed or {}
    plain = [F.col(f"`{c}`") for c in columns]
    now = [changed.get(c, p) for c, p in zip(columns, plain)]
    hashed = lambda cols: F.sha2(F.concat(*map(sized, cols)), 256)
    leaf = docs.select(F.col(f"`{group}`").cast("string").alias("grp"), F.col(f"`{order}`").cast("long").alias("doc_id"), hashed(plain).alias("node"), hashed(now).alias("found"))
    leaf = leaf.withColumn("found", F.when(F.col("found") != F.col("node"), F.col("found")))  # most rows are as they were
    leaves = scratch.write(leaf, "leaves")
    leaves = scratch.write(ordered(leaves, "grp", ["doc_id", "node", "found"], scratch, "leaf"), "ordered")
    scratch.drop("leaves", "leaf_ranges", "leaf_pieces")
    by_source = Tree(leaves, scratch, "source", fanout, levels)
    subroots = scratch.write(by_source.roots(), "subroots")
    one = scratch.write(ordered(subroots.select(F.lit("").alias("all"), F.col("grp").alias("source"), "node"), "all", ["source"], scratch, "top").withColumnRenamed("all", "grp"), "top_ordered")
    top = Tree(one, scratch, "top", fanout, levels)
    root = top.roots().withColumnRenamed("node", "root")  # one row, or none
    lowest, upper = top.proofs(root.select("grp", F.lit(0).cast("long").alias("idx"), F.array().cast("array<string>").alias("proof"), "root"), ["root"])
    of_sources = lowest.groupBy("grp", "bucket").cogroup(upper.groupBy("grp", "bucket")).applyInPandas(_subroots(fanout), "grp string, idx long, proof array<string>, subroot string, root string")
    of_sources = scratch.write(of_sources, "of_sources")
    lowest, upper = by_source.proofs(of_sources, ["subroot", "root"])
    lowest = lowest.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas makes floats of integers with nulls
    made = lowest.groupBy("grp", "bucket").cogroup(upper.groupBy("grp", "bucket")).applyInPandas(_verify(fanout, with_proof), _OUT + (", proof array<string>" if with_proof else ""))
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def _subroots(fanout: int):
    made = _proofs(fanout, ["root"])

    def run(lower: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        lower = lower.sort_values("idx")
        out = made(lower, upper)
        return pd.DataFrame({"grp": lower["source"].to_numpy(), "idx": 0, "proof": out["proof"].to_numpy(), "subroot": lower["node"].to_numpy(), "root": out["root"].to_numpy()})

    return run


def tampered(text: Column) -> Column:
    """A text with its ASCII capitals in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
