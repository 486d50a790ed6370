"""Ground-truth quality of decisions and findings: cases against results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARGIN = ("REVIEW", "QUARANTINE", "BLOCK")


def codes(c: str) -> Column:
    """A comma-joined list as a sorted set."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda x: x != "")))


def match(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Cases with their last result; cases without one are left out. Of results of one run that with the greatest findings, then latency, counts."""
    last = results.withColumn("nth", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("run"), F.desc("actual"), F.desc("latency_ms")))).where("nth = 1").drop("nth")
    return cases.join(last, "case_id").withColumns({"expected": codes("expected"), "acceptable": codes("acceptable"), "actual": codes("actual"), "decisions": codes("decisions")})


def differences(matched: DataFrame) -> DataFrame:
    """Missing and unexpected findings, and whether the decision is an accepted one (null without one)."""
    more = F.array_except("actual", F.array_union("expected", "acceptable"))
    return matched.withColumns({"missing": F.array_except("expected", "actual"), "unexpected": F.when(F.col("any_additional"), F.array().cast("array<string>")).otherwise(more), "compliant": F.when(F.col("decision").isNotNull(), F.array_contains("decisions", F.col("decision")))})


def completeness_class() -> Column:
    """Why an analysis wasn't complete, from complete, worker_status and actual."""
    has = lambda *ends: F.exists("actual", lambda c: F.lit(False) if not ends else _ends(c, ends))
    return F.when(F.col("complete").isNull(), None).when(F.col("complete"), "COMPLETE").when(F.col("worker_status") == "TIMEOUT", "TIMEOUT").when(has("_MALFORMED"), "MALFORMED").when(has("_RESOURCE_LIMIT"), "RESOURCE_LIMIT").when(has("_ENCRYPTED", "_PARTIAL_ANALYSIS", "_NESTING_LIMIT"), "PARTIAL").otherwise("OTHER_FAIL_CLOSED")


def _ends(c: Column, ends: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for e in ends:
        out = out | F.endswith(c, F.lit(e))
    return out


def rate(numerator: Column, denominator: Column) -> Column:
    return F.round(F.try_divide(numerator, denominator), 6)


def metrics(matched: DataFrame) -> DataFrame:
    """All rates in one pass: one row of numerators, denominators and rates."""
    risky = (F.col("category") == "RISKY") & (F.size("expected") > 0)
    benign = F.col("category") == "BENIGN"
    pairs = {
        "risky_recall": (risky & (F.size("missing") == 0), risky),
        "benign_escalation": (benign & F.col("decision").isin(*MARGIN), benign),
        "benign_allow": (benign & (F.col("decision") == "ALLOW"), benign),
        "compliance": (F.coalesce("compliant", F.lit(False)), F.lit(True)),
        "fail_secure": (F.col("fail_secure") & F.coalesce(F.col("release_eligible") == F.lit(False), F.lit(False)), F.col("fail_secure")),
        "recovery": (F.col("cdr_eligible") & F.coalesce("derived_release", F.lit(False)), F.col("cdr_eligible")),
    }
    out = [x for name, (n, d) in pairs.items() for x in (F.count_if(F.coalesce(n, F.lit(False))).alias(f"{name}_n"), F.count_if(d).alias(f"{name}_d"), rate(F.count_if(F.coalesce(n, F.lit(False))), F.count_if(d)).alias(name))]
    hits = F.size(F.array_intersect("expected", "actual"))
    return matched.agg(*out, F.sum(hits).alias("finding_recall_n"), F.sum(F.size("expected")).alias("finding_recall_d"), rate(F.sum(hits), F.sum(F.size("expected"))).alias("finding_recall"))


def latency(results: DataFrame) -> DataFrame:
    """Count, mean, median, bounds and nearest-rank 95th percentile."""
    p95 = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)")
    return results.agg(F.count("latency_ms").alias("n"), F.round(F.avg("latency_ms"), 6).alias("mean"), F.percentile("latency_ms", F.lit(0.5)).alias("median"), F.min("latency_ms").alias("low"), F.max("latency_ms").alias("high"), p95.cast("long").alias("p95"))


def run_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cases (case_id, decision, worker_status, latency_ms) of two runs that differ, or that only one run has.

    A missing decision equals a missing one. Each run has a case once.
    """
    columns = ("decision", "worker_status", "latency_ms")
    a = before.select("case_id", F.struct(*columns).alias("a"))
    b = after.select("case_id", F.struct(*columns).alias("b"))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    same = F.col("a.decision").eqNullSafe(F.col("b.decision")) & F.col("a.worker_status").eqNullSafe(F.col("b.worker_status"))
    rows = a.join(b, "case_id", "full").withColumn("kind", kind).where((F.col("kind") != "changed") | ~same)
    return rows.select("case_id", F.col("a.decision").alias("before"), F.col("b.decision").alias("after"), (F.col("b.latency_ms") - F.col("a.latency_ms")).alias("latency_change"), "kind")


def result_rows(matched: DataFrame) -> DataFrame:
    """The fifteen columns of a result file, from differences() and an error column."""
    return matched.select(
        "case_id", "category", "case_class", F.col("decision").alias("actual_decision"), F.col("decisions").alias("acceptable_decisions"), F.col("compliant").alias("decision_compliant"), "release_eligible", F.col("complete").alias("analysis_complete"), completeness_class().alias("completeness_class"),
        "worker_status", (F.size("missing") == 0).alias("findings_recall_pass"), F.col("missing").alias("missing_expected_findings"), F.col("unexpected").alias("unexpected_findings"), "latency_ms", "error",
    )


def completeness_counts(results: DataFrame) -> DataFrame:
    """bucket, n: all results by their completeness class, UNKNOWN where it can't be told."""
    return results.withColumn("actual", codes("actual")).groupBy(F.coalesce(completeness_class(), F.lit("UNKNOWN")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def side_by_side(before: DataFrame, after: DataFrame) -> DataFrame:
    """metric, before, after, change of two runs (decision, worker_status, latency_ms, compliant)."""

    def told(run: DataFrame, name: str) -> DataFrame:
        of = lambda c: F.count_if(F.coalesce(c, F.lit(False))).cast("double")
        values = {"cases": F.count(F.lit(1)).cast("double"), "allowed": of(F.col("decision") == "ALLOW"), "timeouts": of(F.col("worker_status") == "TIMEOUT"), "mean_latency": F.round(F.avg("latency_ms"), 6), "compliant": of(F.col("compliant"))}
        row = run.agg(*[v.alias(k) for k, v in values.items()])
        return row.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values))).alias("metric", name))

    return told(before, "before").join(told(after, "after"), "metric").withColumn("change", F.round(F.col("after") - F.col("before"), 6))


def case_lines(cases: DataFrame) -> DataFrame:
    """Cases with a line that shows them: id, category, class, expected codes, decisions, F if it must fail securely, C if it is followed up."""
    bars = lambda c: F.when(F.col(c) == "", "-").otherwise(F.replace(F.col(c), F.lit(","), F.lit("|")))
    return cases.withColumn("line", F.concat_ws(" ", F.col("case_id").cast("string"), "category", "case_class", bars("expected"), bars("decisions"), F.when(F.col("fail_secure"), "F"), F.when(F.col("follow_up"), "C")))


def case_rules(findings: DataFrame) -> dict[str, Column]:
    """What holds of a case whose lists are arrays; the findings' table is of fixed size."""
    known = F.array(*[F.lit(r["code"]) for r in findings.select("code").collect()])
    hard = F.array(*[F.lit(r["code"]) for r in findings.where("hard_block").select("code").collect()])
    none = lambda c: F.size(c) == 0
    ordered = lambda c: F.col(c) == F.array_sort(F.array_distinct(c))
    return {
        "unknown_code": none(F.array_except(F.array_union("expected", "acceptable"), known)), "overlap": ~F.arrays_overlap("expected", "acceptable"), "any_excludes_list": ~F.col("any_additional") | none("acceptable"),
        "fail_secure_allow": ~F.col("fail_secure") | ~F.array_contains("decisions", "ALLOW"), "fail_secure_complete": ~F.col("fail_secure") | ~F.col("complete"), "follow_up": ~F.col("derived_expected") | F.col("follow_up"),
        "order": ordered("expected") & ordered("acceptable") & (F.size("decisions") == F.size(F.array_distinct("decisions"))), "hard_block_decision": none(F.array_intersect("expected", hard)) | (F.col("decisions") == F.array(F.lit("BLOCK"))),
    }
