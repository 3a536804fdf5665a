"""Calls of outside services (models, embeddings) from inside a plan: retries and rate limits, a batch at a time."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Retry:
    """At most ``attempts`` calls; the wait before the n-th repetition is ``wait * factor ** n`` seconds, ``most`` at most."""

    attempts: int = 1
    wait: float = 0.0
    factor: float = 1.0
    most: float = 60.0

    def call(self, what: Callable, *args):
        for n in range(self.attempts):
            try:
                return what(*args)
            except Exception:  # noqa: BLE001 - any failure of the service counts
                if n + 1 == self.attempts:
                    raise
                time.sleep(min(self.most, self.wait * self.factor**n))


class Bucket:
    """A bucket of tokens: ``rate`` of them a second, ``size`` at most at once."""

    def __init__(self, rate: float, size: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rate, self.size, self.clock, self.sleep = rate, size, clock, sleep
        self.left, self.at = size, clock()

    def take(self, n: float = 1.0) -> None:
        """Wait until ``n`` tokens are there, and take them; more than the bucket holds are taken as debt."""
        now = self.clock()
        self.left = min(self.size, self.left + (now - self.at) * self.rate)
        self.at = now
        if self.left < min(n, self.size):
            wait = (min(n, self.size) - self.left) / self.rate
            self.sleep(wait)
            self.left, self.at = self.left + wait * self.rate, self.clock()
        self.left -= n


def served(column: Column, service: Callable[[list[str]], list], returns: str = "string", batch: int = 64, retry: Retry = Retry(), rate: float | None = None) -> Column:
    """Results of ``service(list of values)`` for every value of a string column; null stays null.

    ``rate`` limits the calls a second of each task; divide the service's limit
    by the number of tasks that run at once.
    """

    @F.pandas_udf(returns)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bucket = Bucket(rate) if rate else None
        for part in parts:
            out = pd.Series([None] * len(part), dtype=object)
            asked = [i for i, v in enumerate(part) if v is not None]
            for k in range(0, len(asked), batch):
                some = asked[k : k + batch]
                if bucket:
                    bucket.take()
                for i, v in zip(some, retry.call(service, [part.iloc[j] for j in some])):
                    out.iloc[i] = v
            yield out

    return run(column)


def token_counts(column: Column, path: str) -> Column:
    """Tokens of each text by the tokenizer of a file: ``.tiktoken`` ranks, a sentencepiece ``.model`` or a ``tokenizers`` JSON; null stays null."""

    @F.pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = _counter(path)
        for part in parts:
            yield part.map(lambda t: None if t is None else count(t)).astype("Int64")

    return run(column)


def _counter(path: str) -> Callable[[str], int]:
    if path.endswith(".tiktoken"):
        from base64 import b64decode

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line.strip())}
        # the usual word pattern of byte-level vocabularies
        words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return (lambda e: lambda t: len(e.encode_ordinary(t)))(tiktoken.Encoding("file", pat_str=words, mergeable_ranks=ranks, special_tokens={}))
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        return (lambda e: lambda t: len(e.encode(t)))(SentencePieceProcessor(model_file=path))
    from tokenizers import Tokenizer

    return (lambda e: lambda t: len(e.encode(t, add_special_tokens=False).ids))(Tokenizer.from_file(path))
