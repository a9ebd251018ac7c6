"""Connected components of a table of links, by randomised contraction.

Each round every node hooks to whichever of itself and its neighbours has the
least hash (another hash each round), and links are carried over to the nodes
hooked to. A round leaves a fraction of the nodes, so rounds grow with the
logarithm of the number of links, chains included. Hooks come from a map-side
aggregate; joins read written tables, so adaptive execution can split the rows
of a node with very many links. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.runtime import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) for each node of ``links`` (u long, v long); component: the smallest node reachable.

    Links may repeat, point either way, or join a node with itself.
    """

    def tidy(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u < v").distinct()

    now = scratch.write(tidy(links, "u", "v"), f"{name}-links0")
    hooks, level = [], 0
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(level)).alias("h"), F.col(c).alias("to"))  # noqa: E731, B023
        least = both.groupBy("u").agg(F.min(rank("v")).alias("m"))
        hook = scratch.write(least.select(F.col("u").alias("node"), F.least(rank("u"), F.col("m")).getField("to").alias("to")), f"{name}-hooks{level}")
        left = hook.select(F.col("node").alias("u"), F.col("to").alias("a"))
        right = hook.select(F.col("node").alias("v"), F.col("to").alias("b"))
        level += 1
        now = scratch.write(tidy(now.join(left, "u").join(right, "v"), "a", "b"), f"{name}-links{level}")
        scratch.drop(f"{name}-links{level - 1}")
        hooks.append(hook)
    if not hooks:
        return links.select(F.col("u").alias("node"), F.col("v").alias("component")).filter("node = component").distinct()
    roots = hooks[-1]
    for hook in reversed(hooks[:-1]):
        later = roots.select(F.col("node").alias("to"), F.col("to").alias("root"))
        roots = hook.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("to"))
    roots = scratch.write(roots, f"{name}-roots")
    least = scratch.write(roots.groupBy("to").agg(F.min("node").alias("component")), f"{name}-least")
    return scratch.write(roots.join(least, "to").select("node", "component"), f"{name}-found")
