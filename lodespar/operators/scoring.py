"""Scoring of predictions against labels, as column expressions and one aggregation each.

A field that may be absent has five outcomes; abstaining where the truth is absent is right. Reports are
wide one-row frames (or one row per group), so that any number of slices is one ``groupBy``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespar.functions import skills as S
from lodespar.functions.text import same_location

Z = 1.959963984540054
OUTCOMES = ["abstained", "hallucinated", "missed", "extracted", "wrong"]
FIELDS = ["company", "salary", "location", "skills", "remote", "seniority"]
USABLE, WEAK = 0.15, 0.25
Same = Callable[[Column, Column], Column]


def _missing(c: Column, text: bool) -> Column:
    return c.isNull() | (c == "") if text else c.isNull()


def outcome(predicted: Column, truth: Column, same: Same | None = None, text: bool = True) -> Column:
    """The outcome of one nullable field; the empty string is missing too if the field is text."""
    p, t = _missing(predicted, text), _missing(truth, text)
    equal = (same or (lambda a, b: a == b))(predicted, truth)
    return F.when(t & p, "abstained").when(t, "hallucinated").when(p, "missed").when(equal, "extracted").otherwise("wrong")


def salary_same(a: Column, b: Column) -> Column:
    """Both bounds of struct<min, max> agree, missing ones included."""
    return a["min"].eqNullSafe(b["min"]) & a["max"].eqNullSafe(b["max"])


def wilson(successes: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; (0, 1) without trials."""
    p = F.try_divide(successes.cast("double"), n)
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z / scale * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0), F.when(some, F.least(F.lit(1.0), centre + half)).otherwise(1.0)


def margin(successes: Column, n: Column) -> Column:
    low, high = wilson(successes, n)
    return (high - low) / 2


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def nullable_report(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Of a column of outcomes: n, a count for each, coverage, precision with interval and margin,
    hallucination_rate."""
    counts = df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(column) == o).alias(o) for o in OUTCOMES])
    attempts = F.col("extracted") + F.col("wrong") + F.col("hallucinated")
    counts = counts.withColumn("attempts", attempts)
    low, high = wilson(F.nullif(F.col("extracted"), F.lit(-1)), F.nullif(F.col("attempts"), F.lit(0)))
    none = F.col("attempts") == 0
    low, high = F.when(none, 0.0).otherwise(low), F.when(none, 1.0).otherwise(high)
    return counts.withColumns({"coverage": _share(F.col("attempts"), F.col("n")), "precision": _share(F.col("extracted"), F.col("attempts")), "hallucination_rate": _share(F.col("hallucinated"), F.col("n")), "precision_low": low, "precision_high": high, "precision_margin": (high - low) / 2})


def set_scores(predicted: Column, truth: Column, canonical: bool = True) -> Column:
    """struct<p, r, f1> of two lists as sets: 1 if both are empty, 0 if one is."""
    a, b = (S.canonical(x) if canonical else F.array_distinct(x) for x in (predicted, truth))
    hits = F.size(F.array_intersect(a, b)).cast("double")
    both, one = (F.size(a) == 0) & (F.size(b) == 0), (F.size(a) == 0) | (F.size(b) == 0)
    value = lambda x: F.when(both, 1.0).when(one, 0.0).otherwise(x)
    # p and r have the same numerator, so f1 is 2 * hits / (|a| + |b|).
    return F.struct(value(F.try_divide(hits, F.size(a))).alias("p"), value(F.try_divide(hits, F.size(b))).alias("r"), value(F.try_divide(2 * hits, F.size(a) + F.size(b))).alias("f1"))


def set_report(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    mean = lambda f: F.coalesce(F.avg(F.col(column)[f]), F.lit(0.0))
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), mean("f1").alias("macro_f1"), mean("p").alias("macro_precision"), mean("r").alias("macro_recall"))


def confusion(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """truth, predicted, n; null is a class of its own, named None."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return df.select(*(by or []), name(truth).alias("truth"), name(predicted).alias("predicted")).groupBy(*(by or []), "truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


def accuracy(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    hits = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0))
    return matrix.groupBy(*(by or [])).agg(F.sum("n").alias("n"), _share(hits, F.sum("n")).alias("accuracy"))


def class_recall(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    hits = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0))
    return matrix.groupBy(*(by or []), "truth").agg(F.round(_share(hits, F.sum("n")), 4).alias("recall"))


def label_salary(label: Column) -> Column:
    """A label's pay per year (it is recorded as stated; without a period it is per year)."""
    period = F.coalesce(label["salary_period"], F.lit("year"))
    return F.when(label["salary_min"].isNotNull(), F.struct(S.to_annual(label["salary_min"], period).alias("min"), S.to_annual(label["salary_max"], period).alias("max")))


def judged(pairs: DataFrame) -> DataFrame:
    """Rows with struct columns ``prediction`` (normalised) and ``label``: an outcome for each nullable
    field, ``skills`` scores, and both sides of the enums."""
    p, t = F.col("prediction"), F.col("label")
    pay = F.when(p["salary_min"].isNotNull(), F.struct(p["salary_min"].alias("min"), p["salary_max"].alias("max")))
    return pairs.withColumns({
        "company": outcome(p["company"], t["company"]), "salary": outcome(pay, label_salary(t), salary_same, text=False), "location": outcome(p["location"], t["location"], same_location),
        "skills": set_scores(p["skills"], t["skills"]), "remote": F.struct(t["remote"].alias("truth"), p["remote"].alias("predicted")), "seniority": F.struct(t["seniority"].alias("truth"), p["seniority"].alias("predicted")),
    })


def scores(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All six fields of ``judged`` rows in one aggregation, a wide row (per group)."""
    by = by or []
    aggregates = [F.count(F.lit(1)).alias("n")]
    for f in ("company", "salary", "location"):
        aggregates += [F.count_if(F.col(f) == o).alias(f"{f}_{o}") for o in OUTCOMES]
    aggregates += [F.avg(F.col("skills")[x]).alias(f"skills_{x}") for x in ("p", "r", "f1")]
    aggregates += [F.avg(F.col(f)["truth"].eqNullSafe(F.col(f)["predicted"]).cast("double")).alias(f"{f}_accuracy") for f in ("remote", "seniority")]
    wide = rows.groupBy(*by).agg(*aggregates)
    for f in ("company", "salary", "location"):
        attempts = F.col(f"{f}_extracted") + F.col(f"{f}_wrong") + F.col(f"{f}_hallucinated")
        low, high = wilson(F.col(f"{f}_extracted"), F.nullif(attempts, F.lit(0)))
        wide = wide.withColumns({f"{f}_coverage": _share(attempts, F.col("n")), f"{f}_precision": _share(F.col(f"{f}_extracted"), attempts), f"{f}_hallucination_rate": _share(F.col(f"{f}_hallucinated"), F.col("n")), f"{f}_low": F.coalesce(low, F.lit(0.0)), f"{f}_high": F.when(attempts == 0, 1.0).otherwise(high)})
    return wide


def agrees(field: str) -> Column:
    """Whether a judged row's field agrees with its label."""
    if field == "skills":
        return F.col("skills")["f1"] == 1
    if field in ("remote", "seniority"):
        return F.col(field)["truth"].eqNullSafe(F.col(field)["predicted"])
    return F.col(field).isin("extracted", "abstained")


def outcomes(rows: DataFrame, by: list[str], column: str = "outcome") -> DataFrame:
    """How often each outcome occurs per group."""
    return rows.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))


def disagreements(rows: DataFrame, configs: list[str] | None = None) -> DataFrame:
    """field, and for each config how many rows disagree. ``rows`` are judged, with ``config``."""
    marks = F.array(*[F.struct(F.lit(f).alias("field"), (~agrees(f)).cast("int").alias("off")) for f in FIELDS])
    long = rows.select("config", F.explode(marks).alias("m")).select("config", "m.*")
    return long.groupBy("field").pivot("config", configs).agg(F.sum("off"))


def latencies(df: DataFrame, column: str, by: list[str] | None = None, cells: int = 256) -> DataFrame:
    """n, p50, p95 (the element before rank 0.95 n, rounded down) and p95_nearest (nearest rank), exact.

    Approximate quantiles cut each group into cells; counts by cell tell which cells hold the wanted
    ranks, and only the distinct values of those cells are ordered. No task sees a whole group.
    """
    by = by or []
    some = df.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("_v"))
    cuts = some.groupBy(*by).agg(F.percentile_approx("_v", [i / cells for i in range(1, cells)], 40 * cells).alias("_cuts"))
    rows = some.join(cuts, by) if by else some.crossJoin(F.broadcast(cuts))
    counts = rows.withColumn("_cell", F.size(F.filter("_cuts", lambda x: x < F.col("_v")))).groupBy(*by, "_cell", "_v").agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    per = counts.groupBy(*by, "_cell").agg(F.sum("_c").alias("_of"))  # at most ``cells`` rows a group
    per = per.withColumn("_to", F.sum("_of").over(group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("_of").over(group))
    # Ranks from 1. Rank 0 is the last element, as an index of -1 is.
    down = F.when(F.floor(F.col("n") * 0.95) < 1, F.col("n")).otherwise(F.floor(F.col("n") * 0.95))
    ranks = {"_a": F.floor((F.col("n") + 1) / 2), "_b": F.floor((F.col("n") + 2) / 2), "p95": down, "p95_nearest": F.ceil(F.col("n") * 0.95)}
    per = per.withColumns(ranks).withColumn("_from", F.col("_to") - F.col("_of"))
    wanted = per.where(reduce(lambda x, y: x | y, [(F.col(r) > F.col("_from")) & (F.col(r) <= F.col("_to")) for r in ranks]))
    inside = Window.partitionBy(*by, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = counts.join(wanted, [*by, "_cell"]).withColumn("_hi", F.col("_from") + F.sum("_c").over(inside))
    at = lambda r: F.min(F.when((F.col(r) <= F.col("_hi")) & (F.col(r) > F.col("_hi") - F.col("_c")), F.col("_v")))
    return found.groupBy(*by).agg(F.max("n").alias("n"), ((at("_a") + at("_b")) / 2).alias("p50"), at("p95").alias("p95"), at("p95_nearest").alias("p95_nearest"))


def unpivoted(wide: DataFrame, keys: list[str], fields: dict[str, str], name: str = "field", value: str = "score") -> DataFrame:
    """One row for each key and field; ``fields`` maps names to columns."""
    return reduce(DataFrame.unionByName, [wide.select(*keys, F.lit(f).alias(name), F.col(c).cast("double").alias(value)) for f, c in fields.items()]) if len(fields) == 1 else wide.select(*keys, *[F.col(c).cast("double").alias(f) for f, c in fields.items()]).unpivot(keys, list(fields), name, value)


def tokens(usage: DataFrame, by: list[str]) -> DataFrame:
    """Token sums with cache reads and writes taken out of the input, and whether any row's usage is
    missing or impossible."""
    bad = F.col("input_tokens").isNull() | F.col("output_tokens").isNull() | (F.least("input_tokens", "output_tokens", "cache_read", "cache_write") < 0) | (F.col("input_tokens") < F.col("cache_read") + F.col("cache_write"))
    bad = F.coalesce(bad, F.lit(True))
    total = lambda c: F.coalesce(F.sum(F.when(~bad, c)), F.lit(0))
    return usage.groupBy(*by).agg(total(F.col("input_tokens") - F.col("cache_read") - F.col("cache_write")).alias("input"), total(F.col("output_tokens")).alias("output"), total(F.col("cache_read")).alias("cache_read"), total(F.col("cache_write")).alias("cache_write"), F.count(F.lit(1)).alias("responses"), F.bool_or(bad).alias("usage_missing"))


def cost(tokens: DataFrame, rates: dict[str, float]) -> DataFrame:
    """``cost_usd`` from rates for a million tokens of each kind."""
    return tokens.withColumn("cost_usd", sum((F.col(k) * r for k, r in rates.items()), F.lit(0.0)) / 1_000_000)


def cost_complete(config: Column, responses: Column, missing: Column, errors: Column) -> Column:
    """F may need no call at all; any other config without responses is incomplete."""
    return (errors == 0) & ~missing & ((responses > 0) | (config == "F"))


def cost_per_post(cost_usd: Column, posts: Column) -> Column:
    return F.try_divide(cost_usd, posts)


def derived_accuracy(report: DataFrame) -> DataFrame:
    """Accuracy of a nullable field, (extracted + abstained) / n, with its interval."""
    right = F.col("extracted") + F.col("abstained")
    low, high = wilson(right, F.nullif(F.col("n"), F.lit(0)))
    return report.withColumns({"accuracy": _share(right, F.col("n")), "accuracy_low": F.coalesce(low, F.lit(0.0)), "accuracy_high": F.coalesce(F.when(F.col("n") > 0, high), F.lit(1.0))})


def verdict(m: Column) -> Column:
    """What a slice of this margin can show."""
    return F.when(m <= USABLE, "usable").when(m <= WEAK, "weak").otherwise("too small")


def checked(df: DataFrame, proportions: list[str] = (), counts: list[str] = (), intervals: list[tuple[str, str]] = ()) -> DataFrame:
    """``df``, raising on a row with a proportion outside [0, 1], a negative count or a crossed interval."""
    rules = [(F.col(c).isNull() | F.col(c).between(0, 1), c) for c in proportions] + [(F.col(c).isNull() | (F.col(c) >= 0), c) for c in counts]
    rules += [(F.col(a).isNull() | F.col(b).isNull() | ((F.col(a) <= F.col(b)) & F.col(a).between(0, 1) & F.col(b).between(0, 1)), f"{a}, {b}") for a, b in intervals]
    for ok, what in rules:
        df = df.where(F.when(ok, True).otherwise(F.raise_error(F.lit(f"out of bounds: {what}")).cast("boolean")))
    return df


def report_table(rows: list[dict], columns: list[str]) -> str:
    """A Markdown table of a small result."""
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows])


def comparison(scores_of: DataFrame, key: str = "config", field: str = "field", value: str = "score", fields: list[str] | None = None) -> DataFrame:
    """One row for each key, a column for each field."""
    return scores_of.groupBy(key).pivot(field, fields).agg(F.first(value))


def sorted_rungs(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """A comparison sorted by one column, unknown values last in both directions; ties by config."""
    c = F.col(column)
    return rows.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "config")


def disagreement_groups(rows: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """field, configs, comment_id: which posts each field is off in, grouped by the configs that are off together."""
    off = F.explode(F.array(*[F.when(~agrees(f), F.lit(f)) for f in fields or FIELDS])).alias("field")
    long = rows.select("comment_id", "config", off).where("field is not null")
    return long.groupBy("field", "comment_id").agg(F.array_join(F.array_sort(F.collect_set("config")), ",").alias("configs")).select("field", "configs", "comment_id")


def write_ladder(spark, folder: str, records: list[dict], off: DataFrame, groups: DataFrame | None = None) -> None:
    """A ladder's report as Markdown and JSON beside one another: records, disagreement counts and, if given, the
    posts of each group. Reports are a row a rung or a field."""
    from lodespar.sources.logs import write_json, write_text

    counts = [r.asDict() for r in off.collect()]
    columns = [c for c in records[0] if c != "scores"] if records else []
    parts = ["# Ladder", report_table(records, columns), "## Disagreements", report_table(counts, off.columns)]
    if groups is not None:
        listed = groups.groupBy("field", "configs").agg(F.count(F.lit(1)).alias("n")).orderBy("field", F.desc("n"), "configs")
        parts += ["## Posts off together", report_table([r.asDict() for r in listed.collect()], listed.columns)]
    write_text(spark, f"{folder}/ladder.md", "\n\n".join(parts) + "\n")
    write_json(spark, {"records": records, "disagreements": counts}, f"{folder}/ladder.json")


def trajectories(rows: DataFrame, by: list[str]) -> DataFrame:
    """What runs did: steps, model calls, tool calls, failed verifications, errors."""
    t = F.col("trace")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(t["steps"]).alias("steps"), F.sum(t["model_calls"]).alias("model_calls"), F.sum(F.size(t["tool_calls"])).alias("tool_calls"), F.sum(t["verify_failures"]).alias("verify_failures"), F.count(t["error"]).alias("errors"))


def frontier(runs: DataFrame) -> DataFrame:
    """The run log as a table of quality and speed, newest last."""
    s = F.col("scores")
    return runs.select("ts", "config", "split", "n", F.round(s["company_precision"], 4).alias("company_precision"), F.round(s["salary_precision"], 4).alias("salary_precision"), F.round(s["location_precision"], 4).alias("location_precision"), F.round(s["skills_f1"], 4).alias("skills_f1"), "p50_ms", "p95_ms").orderBy("ts")
