"""Rule-based rewards of completions, as column expressions over parsed calls and expected names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clamped(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def canonical_format(tool: Column, sources: Column, n_invalid: Column) -> Column:
    """Calls all in native blocks with none invalid: 1; some native: a half; abstaining where no tool is expected: 1."""
    native = F.size(F.filter(sources, lambda s: s == "native"))
    return (
        F.when(~tool, F.when(F.size(sources) == 0, 1.0).otherwise(0.0))
        .when(F.size(sources) == 0, 0.0)
        .when((native == F.size(sources)) & (n_invalid == 0), 1.0)
        .when(native > 0, 0.5)
        .otherwise(0.0)
    )


def clean_stop(tool: Column, text: Column) -> Column:
    """Ends with the call (or has none, where none is expected), and no line plays a role of the chat."""
    leaked = text.contains("<|im_start|>") | text.rlike(r"(?m)^(?U:\s*)(?:user|assistant|system|tool):")
    ends = F.regexp_replace(text, r"(?U)\s+$", "").endswith("</tool_call>")
    return F.when(F.when(tool, ends).otherwise(~text.contains("<tool_call>")) & ~leaked, 1.0).otherwise(0.0)


def tool_selection(tool: Column, expected: Column, predicted: Column) -> Column:
    """Share of expected names that were called at all, less a fifth for each call too many."""
    hit = F.size(F.filter(expected, lambda n: F.array_contains(predicted, n)))
    extra = F.greatest(F.lit(0), F.size(predicted) - F.size(expected))
    value = hit / F.size(expected) - 0.2 * extra
    return F.when(~tool, F.when(F.size(predicted) == 0, 1.0).otherwise(0.0)).when(F.size(expected) == 0, 0.0).otherwise(_clamped(value))


def arguments(tool: Column, key_accuracy: Column, abstained: Column) -> Column:
    return F.when(tool, F.coalesce(key_accuracy, F.lit(0.0))).otherwise(F.when(abstained, 1.0).otherwise(0.0))


def parallel_completion(tool: Column, n_expected: Column, n_predicted: Column) -> Column:
    """How near the number of calls comes to the expected one."""
    n = F.greatest(F.lit(1), n_expected)
    return F.when(~tool, F.when(n_predicted == 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(n_predicted - n_expected) / n))
