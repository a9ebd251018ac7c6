"""Chat messages for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.rules import FIELDS
from noteloom.sources.jsonl import load_split

SYSTEM = "You turn a support worker's rough notes into one JSON case note. Use only what the notes say; mark what they leave out as not recorded; leave out other people's names and contact details."
#: The user's turn names the keys of the note, in their order.
ASK = f"Write one JSON object with these keys and no others, in this order: {', '.join(f[0] for f in FIELDS)}.\nNotes:\n"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def compact(target: Column) -> Column:
    """A JSON object's text without needless white space, keys in their order; as it is if it isn't one."""
    return F.coalesce(F.to_json(F.from_json(target, "map<string,variant>")), target)


def to_chat(df: DataFrame, user: str = "input", target: str | None = "target") -> DataFrame:
    """Adds ``messages``: system, user and, if there is a target column, assistant with the target as compact JSON."""
    turns = [message("system", F.lit(SYSTEM)), message("user", F.concat(F.lit(ASK), F.col(user)))]
    return df.withColumn("messages", F.array(*turns, *([message("assistant", compact(F.col(target)))] if target else [])))


def load_chat(spark: SparkSession, path: str, split: str, schema: str = "id string, stratum string, input string, target string") -> DataFrame:
    """The chat messages of a split that ``write_splits`` wrote; an empty one, or one that isn't there, is an error."""
    found = load_split(spark, path, split, schema)
    if found.isEmpty():
        raise FileNotFoundError(f"no records of split {split!r} in {path}")
    return to_chat(found).select("messages")


def chats(turns: DataFrame) -> DataFrame:
    """A row for each conversation (conv_id, turn, role, text): its messages in order."""
    placed = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(F.transform(placed, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
