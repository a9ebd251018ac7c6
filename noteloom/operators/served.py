"""Models and judges behind an endpoint that speaks the chat completions format, asked from Spark's tasks.

Messages are columns; a task keeps ``at_once`` requests open and asks again, ``tries``
times in all, where none is answered. What isn't answered is an empty draft or an
empty reply, which counts against the note.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.operators import judging
from noteloom.operators.chat import to_chat
from noteloom.operators.drafting import Transform, batched
from noteloom.runtime import fresh_name, ship


@dataclass(frozen=True)
class Endpoint:
    url: str
    model: str
    key: str = "none"
    temperature: float = 0.0
    max_tokens: int = 2500
    timeout: float = 300.0
    tries: int = 2
    at_once: int = 4
    more: dict = field(default_factory=dict)  # further keys of a request


def answer(endpoint: Endpoint, messages: list[dict]) -> str:
    """The text that answers ``messages``; empty if there is none after all tries."""
    asked = {"model": endpoint.model, "messages": messages, "temperature": endpoint.temperature, "max_tokens": endpoint.max_tokens, **endpoint.more}
    headers = {"Content-Type": "application/json", "Authorization": f"Bearer {endpoint.key}"}
    request = urllib.request.Request(f"{endpoint.url.rstrip('/')}/chat/completions", json.dumps(asked).encode(), headers)
    for _ in range(endpoint.tries):
        try:
            with urllib.request.urlopen(request, timeout=endpoint.timeout) as got:
                return json.load(got)["choices"][0]["message"]["content"] or ""
        except (OSError, ValueError, LookupError, TypeError):  # no connection, an error's status, not the format
            continue
    return ""


def model(endpoint: Endpoint) -> Transform:
    """Adds ``draft``, the endpoint's answer to the messages that models are trained on (``chat.to_chat``), and the seconds it took, ``latency_s``."""

    def timed(messages) -> tuple[str, float]:
        start = time.perf_counter()
        text = answer(endpoint, json.loads(messages))
        return text, time.perf_counter() - start

    def run(df: DataFrame) -> DataFrame:
        ship(df.sparkSession)
        asked = fresh_name(df, "__asked")

        def drafted(frames):
            with ThreadPoolExecutor(endpoint.at_once) as pool:
                for pdf in frames:
                    got = list(pool.map(timed, pdf[asked]))
                    yield pdf.assign(draft=[t for t, _ in got], latency_s=[s for _, s in got])

        return batched(drafted, "draft string, latency_s double")(_asked(df, asked)).drop(asked)

    return run


def _asked(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the messages of each input as JSON under ``name``."""
    if "messages" in df.columns:
        raise ValueError("there is a column 'messages' already")
    return to_chat(df.withColumn(name, F.coalesce("input", F.lit(""))), user=name, target=None).withColumn(name, F.to_json("messages")).drop("messages")


#: What a judge is told, and what it is asked about each note: {input} and {draft}.
ROLE = "You review case notes that were drafted from a support worker's rough notes. Reply with one JSON object and nothing else."
QUESTIONS = {
    "faithful": 'Check each number, date, name and event of the note against the rough notes. Other wording is no fault, nor is a field marked as not recorded. List what the rough notes don\'t say.\n\nROUGH NOTES\n{input}\n\nNOTE\n{draft}\n\nReply as {{"is_faithful": true or false, "fabricated_claims": ["..."], "reasoning": "..."}}',
    "register": 'Read only narrative_summary of this note. Is it written as a record: third person, whole sentences, no fillers, no slang? Being short is no fault.\n\nNOTE\n{draft}\n\nReply as {{"meets_register": true or false, "score": 0 to 1, "issues": ["..."], "reasoning": "..."}}',
    "billable": 'Does the note say what was delivered, so that the hours can be claimed?\n\nROUGH NOTES\n{input}\n\nNOTE\n{draft}\n\nReply as {{"present": true or false, "reasoning": "..."}}',
}


def judge(endpoint: Endpoint, retries: int = 2) -> Transform:
    """Adds verdicts and what was said (``judging.judge_once``) from three questions about each distinct input and draft."""

    def ask(frames):
        with ThreadPoolExecutor(endpoint.at_once) as pool:
            for pdf in frames:
                inputs, drafts = pdf["input"].fillna(""), pdf["draft"].fillna("")
                replies = {}
                for q, text in QUESTIONS.items():
                    asked = [[{"role": "system", "content": ROLE}, {"role": "user", "content": text.format(input=i, draft=d)}] for i, d in zip(inputs, drafts)]
                    replies[f"{q}_reply"] = list(pool.map(lambda m: answer(endpoint, m), asked))
                yield pdf.assign(**replies)

    def run(df: DataFrame) -> DataFrame:
        ship(df.sparkSession)
        return judging.judge_once(ask, retries, with_said=True)(df)

    return run


def named(spec: str) -> Callable:
    """The function that ``package.module:name`` names; its module goes to the tasks as it is here, so executors need not have it."""
    module, _, name = spec.partition(":")
    try:
        found = importlib.import_module(module)
        function = getattr(found, name)
    except (ImportError, AttributeError) as e:
        raise ValueError(f"no function {spec!r}") from e
    cloudpickle.register_pickle_by_value(found)
    return function
