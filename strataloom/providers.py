"""Text and embedding models as replaceable providers.

A text provider is a function of a DataFrame with `prompt` that adds `reply`; an embedding provider one of a
DataFrame with `text` that adds `embedding`. Replies are null where a model is unavailable.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.parsing import first_balanced

Provider = Callable[[DataFrame], DataFrame]


def stub(expression: Column | Callable[[Column], Column]) -> Provider:
    """A deterministic reply, for tests: an expression of the prompt."""
    return lambda df: df.withColumn("reply", expression(F.col("prompt")) if callable(expression) else expression)


def replay(model_io: DataFrame) -> Provider:
    """Recorded replies by the prompt's SHA-256; null where there is none."""
    known = model_io.select("prompt_sha", F.col("response").alias("reply"))
    return lambda df: df.withColumn("prompt_sha", F.sha2(F.col("prompt").cast("binary"), 256)).join(known, "prompt_sha", "left").drop("prompt_sha")


def recorded(asked: DataFrame, provider: str, model: str) -> DataFrame:
    """Rows of model_io for asked prompts and replies."""
    return asked.select(F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_sha"), F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.col("reply").alias("response")).dropDuplicates(["prompt_sha"])


def _post(url: str, body: dict, timeout: float) -> dict:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"}), timeout=timeout) as r:
        return json.load(r)


def http_text(url: str, model: str, timeout: float = 60, tries: int = 3, calls: int = 8, post: Callable = _post, accept: Callable[[str], bool] | None = None) -> Provider:
    """A model server that takes model and prompt and returns response; `calls` tasks ask at once.

    Adds reply and seconds (what the call took). A reply that `accept` refuses is asked for again, as after an error
    of the connection; after `tries` the reply is null.
    """

    def ask(prompt: str) -> str | None:
        for n in range(tries):
            try:
                told = post(url, {"model": model, "prompt": prompt, "stream": False, "options": {"temperature": 0}}, timeout).get("response", "").strip()
                if accept is None or accept(told):
                    return told
            except OSError:
                time.sleep(0.5 * (n + 1) if n + 1 < tries else 0)
        return None

    def timed(prompt: str | None) -> tuple[str | None, float]:
        began = time.perf_counter()
        return (None if prompt is None else ask(prompt)), round(time.perf_counter() - began, 3)

    @F.pandas_udf("reply string, seconds double")
    def reply(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([timed(p) for p in part], columns=["reply", "seconds"]).astype({"reply": object})

    return lambda df: df.repartition(calls).withColumn("told_", reply("prompt")).withColumns({"reply": F.col("told_.reply"), "seconds": F.col("told_.seconds")}).drop("told_")


def http_judge(url: str, model: str, retries: int = 2, **more) -> Provider:
    """J4, J7. A judge at temperature 0: a reply without readable JSON is asked for again, then it is null."""
    return http_text(url, model, tries=retries + 1, accept=lambda told: first_balanced(told) is not None, **more)


def http_embeddings(url: str, model: str, timeout: float = 30, tries: int = 3, delay: float = 0.05, calls: int = 8, post: Callable = _post) -> Provider:
    """V1, V2. Embeddings from a server, with retries, linear backoff and a pause between calls."""

    def embed(text: str | None) -> list[float] | None:
        if not text or not text.strip():
            return None
        for n in range(tries):
            try:
                found = post(url, {"model": model, "prompt": text.strip()[:8000]}, timeout)["embedding"]
                time.sleep(delay)
                return [float(x) for x in found]
            except (OSError, KeyError):
                time.sleep(n + 1 if n + 1 < tries else 0)
        return None

    @F.pandas_udf("array<float>")
    def vector(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(embed)

    return lambda df: df.repartition(calls).withColumn("embedding", vector("text"))


def hashed_embeddings(size: int = 32) -> Provider:
    """Counts of hashed words: deterministic, for tests; no claim to meaning."""
    def embed(df: DataFrame) -> DataFrame:
        words = F.filter(F.split(F.lower("text"), r"\W+"), lambda w: w != "")
        slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)))
        counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("float"))
        return df.withColumn("embedding", counts)

    return embed
