"""Language models as a map over prompts: a client per task, batches, retries, and a stub that needs no model."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ModelClient(Protocol):
    """What answers a batch of prompts, one answer each; one is made in each task by a factory that can be pickled.

    A client may name in `retried` the exceptions that another try may mend (ServerErrors, if it names none); others end the task.
    """

    def complete(self, prompts: list[str]) -> list[str]: ...


#: Failures of a model's server that are tried again.
ServerErrors = (ConnectionError, TimeoutError)


class StubClient:
    """Answers made from the prompt's hash: as a link decision, an extraction or a tagged event. The same prompt always has the same answer."""

    def __init__(self, task: str = "link"):
        if task not in ("link", "extract", "generate"):
            raise ValueError(f"no task {task!r}")
        self.task = task

    def complete(self, prompts: list[str]) -> list[str]:
        return [self._one(hashlib.md5(p.encode()).hexdigest()) for p in prompts]

    def _one(self, digest: str) -> str:
        odd = int(digest, 16) % 2 == 1
        if self.task == "link":
            return json.dumps({"link": odd, "explanation": digest[:8]})
        if self.task == "extract":
            return "```json\n" + json.dumps({"keywords": digest[:4], "what": digest, "who": "someone", "why": "", "how": "", "where": {"country": "Brazil", "lat": -10, "long": -55}}) + "\n```"
        return "<event>\n" + "".join(f"{k}: {digest[:6]}\n" for k in ("When", "What", "Who", "Why", "Where", "How", "ID")) + "</event>"


def complete(prompts: DataFrame, factory: Callable[[], ModelClient], prompt: str = "prompt", answer: str = "answer", batch: int = 64, tries: int = 5, wait: float = 1.0) -> DataFrame:
    """prompts with the model's answer, null where all tries failed. Every task makes one client; a failed batch is tried again after a growing wait.

    A batch fails with one of the client's `retried` exceptions, or with another number of answers than prompts.
    """
    schema = prompts.withColumn(answer, F.lit(None).cast("string")).schema

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for frame in frames:
            out: list[str | None] = []
            for i in range(0, len(frame), batch):
                texts = frame[prompt].iloc[i : i + batch].tolist()
                out += _answers(client, texts, tries, wait)
            yield frame.assign(**{answer: pd.Series(out, index=frame.index, dtype=object)})

    return prompts.mapInPandas(scan, schema)


def _answers(client: ModelClient, texts: list[str], tries: int, wait: float) -> list[str | None]:
    for k in range(tries):
        if k:
            time.sleep(wait * k)
        try:
            found = client.complete(texts)
        except getattr(client, "retried", ServerErrors):
            continue
        if len(found) == len(texts):
            return list(found)
    return [None] * len(texts)


def last_tokens(tokens: str, most: int, answer_tokens: int):
    """Token ids cut from the left so that the answer still fits in the model's length."""
    n = most - answer_tokens
    return F.when(F.size(tokens) > n, F.slice(tokens, -n, n)).otherwise(F.col(tokens))
