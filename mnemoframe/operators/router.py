"""Query router: weighted rules choose the search type of a text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe.functions.fixed import NEGATION_WINDOW, NEGATIONS, ROUTER_BASE, ROUTER_DEFAULT, ROUTER_PATTERNS, ROUTER_WORDS

_LEFT, _RIGHT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def _fires(text: Column, pattern: str) -> Column:
    """Whether the first match of a rule is not preceded by a negation in its window."""
    at = F.regexp_instr(text, F.lit(f"({pattern})"))
    before = F.lower(F.substring(text, F.greatest(F.lit(1), at - NEGATION_WINDOW), F.least(F.lit(NEGATION_WINDOW), at - 1)))
    negation = f"{_LEFT}({'|'.join(map(re.escape, NEGATIONS))}){_RIGHT}"
    return (at > 0) & ~before.rlike(negation)


def route(queries: DataFrame) -> DataFrame:
    """``(query_id, target, score, runner_up, confident)`` of each ``(query_id, text)``."""
    trimmed = F.trim("text")
    rules = [(t, w, "(?i)" + _LEFT + "(" + "|".join(map(re.escape, words)) + ")" + _RIGHT) for t, w, words in ROUTER_WORDS] + ROUTER_PATTERNS
    targets = list(dict.fromkeys(t for t, _, _ in rules))
    scores = queries.select(
        "query_id",
        *(sum((F.when(_fires(trimmed, p), F.lit(w)).otherwise(F.lit(0.0)) for t, w, p in rules if t == target), F.lit(0.0)).alias(target) for target in targets),
    )
    # the highest score wins; of equals, the one that stands first
    pairs = F.array(*(F.struct(F.col(t).alias("score"), F.lit(-i).alias("order"), F.lit(t).alias("target")) for i, t in enumerate(targets)))
    ranked = scores.select("query_id", F.reverse(F.array_sort(pairs)).alias("r"))
    best, second = F.col("r")[0], F.col("r")[1]
    fired = best["score"] >= ROUTER_BASE
    score = F.when(fired, best["score"]).otherwise(F.lit(ROUTER_BASE))
    runner = F.when(fired, second["score"]).otherwise(best["score"])
    return ranked.select(
        "query_id",
        F.when(fired, best["target"]).otherwise(F.lit(ROUTER_DEFAULT)).alias("target"),
        score.alias("score"),
        runner.alias("runner_up"),
        (score >= 2.0 * F.greatest(runner, F.lit(1.0))).alias("confident"),
    )
