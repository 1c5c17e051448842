"""Evaluation runs and the ladder of rungs against labels."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespar.functions import skills as S
from lodespar.functions.text import slice_name
from lodespar.operators import scoring
from lodespar.plans.rungs import SYSTEM, predictor
from lodespar.session import kept


def with_labels(posts: DataFrame, labels: DataFrame, skip_missing: bool = False) -> tuple[DataFrame, list[str]]:
    """Posts (objectID, text) joined to their labels, and ids without a post (an error unless skipped).
    Labels are the small side: a few hundred at most."""
    missing = [r[0] for r in labels.join(posts, F.col("comment_id") == F.col("objectID"), "left_anti").select("comment_id").collect()]
    if missing and not skip_missing:
        raise KeyError(f"labelled posts not found: {missing}")
    label = F.struct(*[F.col(c) for c in labels.columns]).alias("label")
    return posts.join(labels.select("comment_id", label), F.col("comment_id") == F.col("objectID")).select("comment_id", "text", "label"), missing


def normalised(rows: DataFrame) -> DataFrame:
    """Predictions with canonical skills and pay per year, for every config alike."""
    p = F.col("prediction")
    annual = lambda c: F.when(p["salary_period"].isNull() | (p["salary_period"] == "year"), p[c]).otherwise(S.to_annual(p[c], p["salary_period"]))
    return rows.withColumn("prediction", p.withField("skills", S.canonical(p["skills"])).withField("salary_min", annual("salary_min")).withField("salary_max", annual("salary_max")))


def predicted(pairs: DataFrame, config: str, client: Callable | None = None) -> DataFrame:
    """Judged rows of a config. Predictions are made once and written to the shared folder, as every report reads them
    and answers of a model are paid for."""
    rows = normalised(predictor(config, client)(pairs)).withColumn("config", F.lit(config)).withColumn("slice", slice_name(F.col("text")))
    return kept(scoring.judged(rows), "predicted")


def run(pairs: DataFrame, config: str, split: str | None = None, client: Callable | None = None, source: str = "labels") -> dict:
    """One run's record: scores, slices and latencies, ready for the run log."""
    rows, now = predicted(pairs, config, client), dt.datetime.now(dt.UTC)
    wide = scoring.scores(rows).first().asDict()
    slices = {r["slice"]: {"n": r["n"], "skills_f1": round(r["skills_f1"], 4)} for r in scoring.scores(rows, ["slice"]).collect()}
    times = scoring.latencies(rows.select(F.col("trace.latency_ms").alias("ms")), "ms").first()
    return {
        "run_id": f"{config}-{now:%Y%m%dT%H%M%S}", "ts": now.isoformat(), "config": config, "split": split or "all", "labels_from": source,
        "prompt_sha": hashlib.sha256(("" if config == "rules" else SYSTEM).encode()).hexdigest()[:8],
        "n": wide["n"], "scores": wide, "slices": slices, "p50_ms": times["p50"] if times else None, "p95_ms": times["p95"] if times else None,
    }


def ladder(pairs: DataFrame, clients: dict[str, Callable], rates: dict[str, float], split: str = "dev") -> tuple[list[dict], DataFrame]:
    """A record of each rung with its cost, and the disagreement counts of all."""
    records, judged = [], []
    for config, client in clients.items():
        rows = predicted(pairs, config, client)
        trace = F.col("trace")
        usage = rows.where(trace["model_calls"] > 0).select("config", *[trace[c].alias(c) for c in ("input_tokens", "output_tokens", "cache_read", "cache_write")])
        spent = scoring.cost(scoring.tokens(usage, ["config"]), rates).first()
        errors = rows.where(trace["error"].isNotNull()).count()
        times = scoring.latencies(rows.select(trace["latency_ms"].alias("ms")), "ms").first()
        complete = not errors and not (spent and spent["usage_missing"]) and (spent is not None or config == "F")
        records.append({"config": config, "split": split, "scores": scoring.scores(rows).first().asDict(), "cost_usd": spent["cost_usd"] if spent else 0.0, "cost_complete": complete, "errors": errors, "p50_ms": times["p50"], "p95_ms": times["p95_nearest"]})
        judged.append(rows.select("config", *scoring.FIELDS))
    every = judged[0]
    for rows in judged[1:]:
        every = every.unionByName(rows)
    return records, scoring.disagreements(every, list(clients))
