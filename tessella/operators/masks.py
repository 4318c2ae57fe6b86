"""Token masks: labels for assistant tokens only, padding, and what a loss would see. Tokenizers are passed in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions.batched import rowwise

IGNORED = -100


def labels(ids: str, mask: str, longest: int | None = None) -> Column:
    """Token ids where the mask is 1, else the ignored label; cut to ``longest``. Unequal lengths are an error; without ids and mask there are no labels."""
    out = F.expr(f"if(size({ids}) <=> size({mask}), zip_with({ids}, {mask}, (i, m) -> if(m = 1, i, {IGNORED})), raise_error('ids and mask differ in length'))")
    return out if longest is None else F.slice(out, 1, longest)


def padded(values: Column, size: Column, fill: int) -> Column:
    """Filled up on the right, nothing is cut; a null array is all filling, and without a size there is no array."""
    values = F.coalesce(values, F.array().cast("array<int>"))
    return F.concat(values, F.array_repeat(F.lit(fill), size - F.size(values)))


def collated(df: DataFrame, batch: str, pad: int = 0) -> DataFrame:
    """input_ids, attention_mask and labels on the right padded to the longest row of the batch; a batch without any ids stays null."""
    size = F.max(F.when(F.col("input_ids").isNotNull(), F.size("input_ids"))).over(W.partitionBy(batch))
    out = df.withColumn("__size", size)
    for name, fill in (("input_ids", pad), ("attention_mask", 0), ("labels", IGNORED)):
        out = out.withColumn(name, padded(F.col(name), F.col("__size"), fill))
    return out.drop("__size")


def audit(df: DataFrame) -> DataFrame:
    """One row: examples, tokens, supervised tokens and their share (4 decimals), mean tokens of an example. Null labels are examples of unknown size."""
    known = F.col("labels").isNotNull()
    size = F.when(known, F.size("labels"))
    used = F.when(known, F.size(F.filter("labels", lambda x: x != IGNORED)))
    tokens, loss = F.sum(size), F.sum(used)
    return df.agg(F.count(F.lit(1)).alias("n_examples"), tokens.alias("n_tokens"), loss.alias("n_loss_tokens"), F.round(F.coalesce(F.try_divide(loss, tokens), F.lit(0.0)), 4).alias("supervised_fraction"), F.round(F.avg(size), 4).alias("mean_tokens"))


def prompt_sizes(df: DataFrame, ids: str = "input_ids") -> DataFrame:
    """One row: examples, the longest and the mean prompt in tokens; null prompts count as empty, none give 0."""
    size = F.greatest(F.size(F.coalesce(ids, F.array().cast("array<int>"))), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n_examples"), F.coalesce(F.max(size), F.lit(0)).alias("max_tokens"), F.coalesce(F.avg(size), F.lit(0.0)).alias("mean_tokens"))


def scenarios(df: DataFrame, name: str, kept: str, seen: str, unseen: str) -> DataFrame:
    """Per scenario: whether all its checks hold. kept: text that the loss sees; seen and unseen: arrays of what must and must not be in it.

    An empty list of checks holds; a null text holds nothing.
    """
    text = F.coalesce(F.col(kept), F.lit(""))
    all_seen = F.forall(F.coalesce(F.col(seen), F.array().cast("array<string>")), lambda x: F.contains(text, x))
    any_unseen = F.exists(F.coalesce(F.col(unseen), F.array().cast("array<string>")), lambda x: F.contains(text, x))
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.every(all_seen).alias("all_seen"), F.some(any_unseen).alias("any_unseen"), F.every(all_seen & ~any_unseen).alias("passed"))


def encoded(df: DataFrame, tokenize: Callable[[str], tuple[list[int], list[int]]], text: str, longest: int | None = None) -> DataFrame:
    """``df`` with input_ids, attention_mask, labels and status (ok, invalid or too_long) by a tokenizer that gives ids and mask.

    Rows that are too long are marked, not cut; rows on which the tokenizer fails are invalid.
    """

    @rowwise("struct<ids: array<int>, mask: array<int>>")
    def run(x: str | None) -> dict:
        try:
            ids, mask = tokenize(x)
        except Exception:  # a row of bad input is counted, not fatal
            ids = mask = None
        return {"ids": ids, "mask": mask}

    out = df.withColumn("__t", run(F.col(text)))
    long = F.lit(False) if longest is None else F.size("__t.ids") > longest
    out = out.withColumn("status", F.when(F.col("__t.ids").isNull(), "invalid").when(long, "too_long").otherwise("ok"))
    out = out.withColumn("input_ids", F.col("__t.ids")).withColumn("attention_mask", F.transform("__t.ids", lambda _: F.lit(1)))
    return out.withColumn("labels", F.when(F.col("__t.ids").isNotNull(), labels("__t.ids", "__t.mask"))).drop("__t")


# The marks of a part that is trained on, and what an assistant's turn begins and ends with in a template.
BEGIN, END = "{% generation %}", "{% endgeneration %}"
HEAD, TAIL = "'<|im_start|>assistant\\n' }}", "{{- '<|im_end|>\\n' }}"
_UNFIT = "the template has no single assistant part to mark"


def marked_template(template: str) -> str:
    """A chat template with generation marks around the assistant's part; marked ones are left as they are.

    The assistant branch must write its opening turn token exactly once, and its closing one after that.
    """
    if BEGIN in template:
        return template
    before, head, rest = template.partition(HEAD)
    inner, tail, after = rest.partition(TAIL)
    if not head or not tail or HEAD in rest:
        raise ValueError(_UNFIT)
    return f"{before}{head}{BEGIN}{inner}{tail}{END}{after}"


def marked_templates(template: Column) -> Column:
    """:func:`marked_template` over a column of templates; null stays null, a template that can't be marked is an error."""
    once = F.length(template) - F.length(F.replace(template, F.lit(HEAD), F.lit(""))) == len(HEAD)
    fits = once & F.substring_index(template, HEAD, -1).contains(TAIL)
    marked = F.regexp_replace(template, rf"(?s)(\Q{HEAD}\E)(.*?\Q{TAIL}\E)", f"$1{BEGIN}$2{END}")
    return F.when(template.contains(BEGIN), template).when(fits, marked).when(template.isNotNull(), F.raise_error(F.lit(_UNFIT)))
