"""Scoring statement-evidence pairs by a pluggable client, as one map stage and an append-only log."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.operators.belief import noisy_or
from proofloom.operators.belief import passes as passes_gate
from proofloom.operators.ingest import content_key
from proofloom.sources.sinks import append_log, has_rows


class ScoreClient(Protocol):
    """Answers one pair with a dictionary that has score, verdict and confidence; may raise."""

    def score(self, claim: str, text: str) -> dict: ...


class RuleClient:
    """A deterministic client: correct if all names of the claim occur in the text, abstain without a text, else incorrect."""

    def score(self, claim: str, text: str) -> dict:
        if not text.strip():
            return {"score": 0.5, "verdict": "abstain", "confidence": "low"}
        names = [w for w in claim.split() if any(c.isdigit() for c in w)]
        ok = all(n.lower() in text.lower() for n in names)
        return {"score": 0.95 if ok else 0.2, "verdict": "correct" if ok else "incorrect", "confidence": "high" if ok else "medium"}


__all__ = ["RuleClient", "ScoreClient", "aggregated", "last_json", "passes_gate", "score_corpus", "scored"]
_OUT = "stmt_hash string, evidence_hash string, score double, verdict string, confidence string, error string, output_json string"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def scored(pairs: DataFrame, client: Callable[[], ScoreClient]) -> DataFrame:
    """Every pair (stmt_hash, evidence_hash, claim, text) with its score; a failing call gives a row with its error.

    ``client`` is called once per task. A failure has a null score, the verdict abstain and low confidence; null
    claims and texts are passed on as empty ones. Nothing is shuffled.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = client()
        for b in batches:
            out = []
            for stmt, ev, claim, text in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    r, error = one.score(claim or "", text or ""), None
                except Exception as e:  # the pair's own failure, recorded in its row
                    error = f"{type(e).__name__}: {e}"
                    r = {"score": None, "verdict": "abstain", "confidence": "low", "error": error}
                score = r.get("score")
                out.append((stmt, ev, None if score is None else float(score), r.get("verdict"), r.get("confidence"), error, json.dumps(r, sort_keys=True)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.float64() if i == 2 else pa.string()) for i in range(7)], names=_NAMES)

    return pairs.select("stmt_hash", "evidence_hash", "claim", "text").mapInArrow(rows, _OUT)


def score_corpus(pairs: DataFrame, client: Callable[[], ScoreClient], run_id: str, version: str, log: str) -> int:
    """Score the pairs that the run's log does not hold and append them; returns how many were appended.

    The key of a step is made of run, pair and scorer version, so an interrupted run goes on where it stopped and a
    finished one appends nothing. Repeated pairs are scored once.
    """
    key = content_key(F.lit(run_id), F.col("stmt_hash"), F.col("evidence_hash"), F.lit(version), F.lit("aggregate"))
    todo = pairs.dropDuplicates(["stmt_hash", "evidence_hash"]).withColumn("step_hash", key)
    if has_rows(pairs.sparkSession, log):
        todo = todo.join(pairs.sparkSession.read.parquet(log).select("step_hash"), "step_hash", "left_anti")
    x = scored(todo, client).withColumn("step_hash", key).withColumns({"run_id": F.lit(run_id), "step_kind": F.lit("aggregate"), "started_at": F.current_timestamp()})
    return append_log(x, log)


def last_json(text: Column) -> Column:
    """The last top-level JSON object of a free text, as text; null without one.

    Read from the back: of every closing brace the opening braces before it are tried, the farthest first, so the
    object found is not part of a larger one.
    """
    @F.pandas_udf("string")
    def find(s: pd.Series) -> pd.Series:
        return s.map(_last_object)

    return find(text)


def _last_object(text: str | None) -> str | None:
    opened, closed = ([m.start() for m in re.finditer(c, text or "")] for c in (r"\{", r"\}"))
    for end in reversed(closed):
        for start in opened:
            if start > end:
                break
            try:
                x = json.loads(text[start : end + 1])
            except (ValueError, RecursionError):
                continue
            return json.dumps(x)
    return None


def aggregated(steps: DataFrame, keys: list[str], how: str | Callable[[list[float]], float]) -> DataFrame:
    """Scores per key by mean, noisy_or, or any function of the list of scores; null scores are left out.

    A function runs as a grouped aggregate on Arrow batches, whose lists are a statement's scores.
    """
    if how == "mean":
        return steps.groupBy(*keys).agg(F.avg("score").alias("score"))
    if how == "noisy_or":
        return steps.groupBy(*keys).agg(noisy_or(F.col("score")).alias("score"))
    if not callable(how):
        raise ValueError(f"unknown aggregator {how}")
    f = how

    @F.pandas_udf("double")
    def own(s: pd.Series) -> float:
        return float(f(s.tolist()))

    return steps.filter("score is not null").groupBy(*keys).agg(own("score").alias("score"))
