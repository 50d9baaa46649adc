"""Statistics over evaluation runs, call logs and extraction logs.

Run rows: (suite_id, case_id, case_index, sample, score, failed, truncated, ...).
Every operator is a combinable aggregate keyed by the suite or case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.naming import error_class

Z95 = 1.96  # fixed value: two-sided 95% normal quantile
CASE = ["suite_id", "case_id"]


def sample_score(passed: Column, total: Column, penalties: dict[float, Column]) -> Column:
    """Share passed minus weighted penalties, never below zero."""
    raw = passed / total
    for weight, count in penalties.items():
        raw = raw - F.lit(weight) * count
    return F.greatest(F.lit(0.0), raw)


def ambiguity_excess(reported: Column, budget: Column) -> Column:
    return F.when(budget.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), reported - budget))


def margin_of_error(standard_error: Column) -> Column:
    return F.lit(Z95) * standard_error


def case_summary(runs: DataFrame, floor: float | None = None) -> DataFrame:
    """Per case: mean, worst, samples, failures, truncations, sd; with a floor also collapses and quality mean and sd."""
    score = F.col("score")
    aggs = [
        F.coalesce(F.avg(score), F.lit(0.0)).alias("mean"), F.coalesce(F.min(score), F.lit(0.0)).alias("worst"),
        F.count(score).alias("samples"), F.count_if("failed").alias("failures"), F.count_if("truncated").alias("truncations"),
        F.stddev_samp(score).alias("sd"),
    ]
    if floor is not None:
        above = F.when(score >= floor, score)
        aggs += [F.count_if(score < floor).alias("collapses"), F.avg(above).alias("quality_mean"), F.stddev_samp(above).alias("quality_sd")]
    return runs.groupBy(*CASE, "case_index").agg(*aggs)


def suite_summary(cases: DataFrame) -> DataFrame:
    """Unweighted mean of case means over cases with samples, worst case, failures, and whether every run came back."""
    scored = F.col("samples") > 0
    return cases.groupBy("suite_id").agg(
        F.coalesce(F.avg(F.when(scored, F.col("mean"))), F.lit(0.0)).alias("mean"), F.coalesce(F.min(F.when(scored, F.col("worst"))), F.lit(0.0)).alias("worst"),
        F.sum("failures").alias("failures"), F.sum("truncations").alias("truncations"), (F.sum("failures") == 0).alias("complete"))


def dispersion(cases: DataFrame) -> DataFrame:
    """Standard error of the suite mean, the difference two runs can resolve, and the case that dominates the variance.

    A case with one sample has no sd: the error is then a lower bound. When no
    case has one, nothing is known and the error stays NULL.
    """
    scored = cases.filter("samples > 0")
    variance = F.coalesce(F.col("sd") * F.col("sd") / F.col("samples"), F.lit(0.0))
    rows = scored.withColumn("variance", variance)
    summed = rows.groupBy("suite_id").agg(
        F.count("*").alias("k"), F.sum("variance").alias("total"), F.max(F.col("sd").isNull()).alias("lower_bound"), F.min(F.col("sd").isNull()).alias("unknown"),
        F.max_by(F.struct("case_id", "variance"), F.struct("variance", -F.col("case_index"))).alias("top"))
    error = F.when(F.col("total") > 0, F.sqrt("total") / F.col("k")).when(~F.col("unknown"), F.lit(0.0))
    some = F.col("total") > 0
    found = summed.select(
        "suite_id", error.alias("standard_error"), "lower_bound", (F.lit(Z95) * error * F.sqrt(F.lit(2.0))).alias("resolvable_difference"),
        F.when(some, F.col("top.case_id")).alias("dominant_case"), F.when(some, F.col("top.variance") / F.col("total")).alias("dominant_share"))
    return cases.select("suite_id").distinct().join(found, "suite_id", "left").withColumn("lower_bound", F.coalesce("lower_bound", F.lit(False)))


def merged_tallies(runs: DataFrame, tallies: str, keys: list[str]) -> DataFrame:
    """Maps of rule -> count summed over runs, one row per rule (a map column would grow with the number of rules)."""
    return runs.select(*keys, F.explode(tallies).alias("rule_id", "n")).groupBy(*keys, "rule_id").agg(F.sum("n").alias("n"))


def tallies_as_map(merged: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``merged_tallies`` as one map per key; for keys whose number of rules is known to be small."""
    return merged.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule_id", "n")))).alias("tallies"))


def token_totals(runs: DataFrame) -> DataFrame:
    """Prompt and completion tokens per suite (NULL when none were reported) and cache tokens (NULL when unreported)."""
    def total(name: str) -> Column:
        return F.sum(F.coalesce(name, F.lit(0)))

    used = (total("prompt_tokens") != 0) | (total("completion_tokens") != 0)
    cached = F.max(F.col("cache_read").isNotNull() | F.col("cache_write").isNotNull())
    return runs.groupBy("suite_id").agg(
        F.when(used, total("prompt_tokens")).alias("prompt"), F.when(used, total("completion_tokens")).alias("completion"),
        F.when(cached, total("cache_read")).alias("cache_read"), F.when(cached, total("cache_write")).alias("cache_write"))


def mean_penalties(runs: DataFrame) -> DataFrame:
    """Mean corrections, errors and warnings per case over scored runs."""
    return runs.filter("score IS NOT NULL").groupBy(*CASE).agg(*[F.avg(c).alias(c) for c in ("corrections", "errors", "warnings")])


def kept_payloads(runs: DataFrame) -> DataFrame:
    """Which samples keep their payload: the worst and the best scored one of each case, and every unscorable one.

    Equal scores go to the earlier sample.
    """
    ranked = runs.filter("score IS NOT NULL AND error IS NULL").groupBy(*CASE).agg(
        F.min_by("sample", F.struct("score", "sample")).alias("worst"), F.max_by("sample", F.struct("score", -F.col("sample"))).alias("best"))
    chosen = ranked.select(*CASE, F.explode(F.array_distinct(F.array("worst", "best"))).alias("sample"))
    unscorable = runs.filter("score IS NOT NULL AND error IS NOT NULL").select(*CASE, "sample")
    return chosen.unionByName(unscorable)


def recordable(suites: DataFrame, force: bool = False) -> DataFrame:
    """Suites that may enter the history: complete ones, or all when forced."""
    return suites if force else suites.filter("complete")


def call_summary(calls: DataFrame) -> DataFrame:
    """Calls by provider, model and error class: count, successes, mean latency, tokens."""
    kind = F.when(~F.col("ok"), error_class(F.coalesce("error", F.lit(""))))
    model = F.coalesce("model_used", "model")
    return calls.groupBy("provider", model.alias("model"), kind.alias("error_kind")).agg(
        F.count("*").alias("calls"), F.count_if("ok").alias("succeeded"), F.avg("latency_ms").alias("mean_latency_ms"),
        F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"), F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion_tokens"))


def correction_summary(corrections: DataFrame, builds: DataFrame) -> DataFrame:
    """Corrections per run and category next to the run's build counts; runs without corrections have a NULL category."""
    counts = corrections.groupBy("run_id", "category").agg(F.count("*").alias("n"))
    totals = corrections.groupBy("run_id").agg(F.count("*").alias("corrections"))
    return builds.join(counts, "run_id", "left").join(totals, "run_id", "left").withColumn("corrections", F.coalesce("corrections", F.lit(0)))
