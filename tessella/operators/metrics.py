"""Aggregates over scored cases, and comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rows of a report, in order.
ROWS = [
    ("Tool Selection Accuracy", "tool_selection_accuracy"),
    ("Argument Exact Match", "argument_exact_match"),
    ("Argument Key Accuracy", "argument_key_accuracy"),
    ("Valid Tool Call Format Rate", "valid_tool_call_format_rate"),
    ("Canonical Tool Format Rate", "canonical_format_rate"),
    ("Tool Abstention Accuracy", "tool_abstention_accuracy"),
    ("Clean Stop Rate", "clean_stop_rate"),
    ("Strict Protocol Success", "strict_protocol_success"),
    ("Overall Exact Match", "overall_exact_match"),
    ("Invalid JSON Rate", "invalid_json_rate"),
    ("Wrong Tool Rate", "wrong_tool_rate"),
    ("Missing Argument Rate", "missing_argument_rate"),
    ("Extra Argument Rate", "extra_argument_rate"),
]


def rate(flag: Column, among: Column | None = None) -> Column:
    """The share of rows with a flag (null: without it) among some; 0 of none."""
    value = F.coalesce(flag.cast("double"), F.lit(0.0))
    return F.coalesce(F.avg(value if among is None else F.when(among, value)), F.lit(0.0))


def aggregate(scores: DataFrame) -> DataFrame:
    """One row of counts and rates over the columns of a score."""
    c, tool = F.col, F.coalesce(F.col("expected_tool"), F.lit(False))
    return scores.agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.count_if(tool).alias("n_tool_cases"),
        F.count_if(~tool).alias("n_no_tool_cases"),
        rate(c("tool_selection_correct"), tool).alias("tool_selection_accuracy"),
        rate(c("arg_exact_match"), tool).alias("argument_exact_match"),
        rate(c("arg_key_accuracy"), tool).alias("argument_key_accuracy"),
        rate(c("valid_format"), tool).alias("valid_tool_call_format_rate"),
        rate(c("canonical_format"), tool).alias("canonical_format_rate"),
        rate(c("no_tool_correct"), ~tool).alias("no_tool_accuracy"),
        rate(c("no_tool_correct"), ~tool).alias("tool_abstention_accuracy"),
        rate(c("clean_stop")).alias("clean_stop_rate"),
        rate(c("strict_protocol_success")).alias("strict_protocol_success"),
        rate(c("strict_protocol_success"), tool).alias("strict_protocol_success_tool"),
        rate(c("strict_protocol_success"), ~tool).alias("strict_protocol_success_no_tool"),
        rate(c("overall")).alias("overall_exact_match"),
        rate(c("invalid_json"), tool).alias("invalid_json_rate"),
        rate(c("wrong_tool"), tool).alias("wrong_tool_rate"),
        rate(c("missing_argument"), tool).alias("missing_argument_rate"),
        rate(c("extra_argument"), tool).alias("extra_argument_rate"),
    )


def by_category(scores: DataFrame) -> DataFrame:
    return scores.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("overall").alias("overall"),
        F.count_if("strict_protocol_success").alias("strict"),
        F.count_if("expected_tool").alias("n_tool"),
        F.count_if(F.col("category").startswith("parallel")).alias("n_parallel_calls"),
        rate(F.col("overall")).alias("accuracy"),
        rate(F.col("strict_protocol_success")).alias("strict_protocol_rate"),
    )


#: What is averaged over the rows of a set: a rate's name, and the column of a score.
FLAGS = {
    "tool_selection_accuracy": "tool_selection_correct", "argument_exact_match": "arg_exact_match", "argument_key_accuracy": "arg_key_accuracy", "valid_tool_call_format_rate": "valid_format", "canonical_format_rate": "canonical_format",
    "tool_abstention_accuracy": "no_tool_correct", "clean_stop_rate": "clean_stop", "strict_protocol_success": "strict_protocol_success", "overall_exact_match": "overall", "invalid_json_rate": "invalid_json", "wrong_tool_rate": "wrong_tool",
    "missing_argument_rate": "missing_argument", "extra_argument_rate": "extra_argument",
}
#: The rates of a report that are taken over cases that expect a tool, over those that don't, and over all.
OF_TOOL = ("tool_selection_accuracy", "argument_exact_match", "argument_key_accuracy", "valid_tool_call_format_rate", "canonical_format_rate", "invalid_json_rate", "wrong_tool_rate", "missing_argument_rate", "extra_argument_rate")
OF_NONE = ("tool_abstention_accuracy",)
OF_ALL = ("clean_stop_rate", "strict_protocol_success", "overall_exact_match")


def by_sets(scores: DataFrame) -> DataFrame:
    """level (all, tool, no_tool or category), category, n, counts and every rate, over all cases, over those that expect a tool
    and those that don't, and over each category: grouping sets, so that the scores are read and shuffled once.

    A case that doesn't say whether it expects a tool expects none; a null category is a category of its own.
    """
    tool = F.coalesce(F.col("expected_tool"), F.lit(False))
    rows = scores.select(*(F.col(c) for c in dict.fromkeys(FLAGS.values())), F.col("category").alias("category"), tool.alias("__tessella_tool"))
    sets = rows.groupingSets([[], ["__tessella_tool"], ["category"]], "__tessella_tool", "category").agg(
        F.grouping("__tessella_tool").alias("__tessella_no_tool_set"),
        F.grouping("category").alias("__tessella_no_category_set"),
        F.count(F.lit(1)).alias("n"),
        F.count_if("overall").alias("n_overall"),
        F.count_if("strict_protocol_success").alias("n_strict"),
        *(rate(F.col(column)).alias(name) for name, column in FLAGS.items()),
    )
    level = F.when(F.col("__tessella_no_category_set") == 0, "category").when(F.col("__tessella_no_tool_set") == 1, "all").when(F.col("__tessella_tool"), "tool").otherwise("no_tool")
    return sets.select(level.alias("level"), "category", "n", "n_overall", "n_strict", *FLAGS)


def overall(sets: DataFrame) -> DataFrame:
    """One row as :func:`aggregate` gives it, from :func:`by_sets`; subsets without cases count 0."""
    of = lambda level, column: F.coalesce(F.max(F.when(F.col("level") == level, F.col(column))), F.lit(0))
    rates = [of(level, name).cast("double").alias(name) for level, names in (("tool", OF_TOOL), ("no_tool", OF_NONE), ("all", OF_ALL)) for name in names]
    strict = [of(level, "strict_protocol_success").cast("double").alias(f"strict_protocol_success_{level}") for level in ("tool", "no_tool")]
    counts = [of(level, "n").cast("long").alias(name) for level, name in (("all", "n_cases"), ("tool", "n_tool_cases"), ("no_tool", "n_no_tool_cases"))]
    return sets.where("level <> 'category'").agg(*counts, *rates, *strict, of("no_tool", "tool_abstention_accuracy").cast("double").alias("no_tool_accuracy"))


def compare(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """key, a, b, delta over the union of keys; a missing side is NaN."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full_outer")
    nan = F.lit(float("nan"))
    both = both.select(key, F.coalesce("a", nan).alias("a"), F.coalesce("b", nan).alias("b"))
    return both.withColumn("delta", F.col("b") - F.col("a"))


def joined_predictions(predictions: DataFrame, cases: DataFrame, id_col: str = "id", order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Predictions with their case, and predictions without one. Of cases with one id the last by ``order`` counts."""
    if order:
        rest = [c for c in cases.columns if c != id_col]
        cases = cases.groupBy(id_col).agg(F.max_by(F.struct(*rest), order).alias("c")).select(id_col, "c.*")
    return predictions.join(cases, id_col), predictions.join(cases, id_col, "left_anti")


def _table(header: list[str], rows: list[list[str]]) -> list[str]:
    """Lines of a markdown table, the first column to the left and the others to the right."""
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return [line(header), "|---|" + "---:|" * (len(header) - 1), *map(line, rows)]


def percent(rate: float | None) -> str:
    return "n/a" if rate is None else f"{100 * rate:.1f}%"


def points(old: float | None, new: float | None) -> str:
    """The change between two rates in percentage points."""
    return "n/a" if old is None or new is None else f"{100 * (new - old):+.1f}pt"


def markdown(a: dict, name: str, b: dict | None = None, other: str = "") -> str:
    """The report's table of one run or of two; rates a run lacks show as n/a."""
    if b is None:
        return "\n".join(_table(["Metric", name], [[title, percent(a.get(key))] for title, key in ROWS]))
    rows = [[title, percent(a.get(key)), percent(b.get(key)), points(a.get(key), b.get(key))] for title, key in ROWS]
    return "\n".join(_table(["Metric", name, other, "Delta"], rows))


def category_lines(rows: list[dict]) -> list[str]:
    """The report's table by category, from rows of :func:`by_category` in order. There are few categories."""
    cells = [[r["category"], str(r["n"]), percent(r["accuracy"]), percent(r["strict_protocol_rate"])] for r in rows]
    return _table(["Category", "n", "Accuracy", "Strict"], cells)
