"""Rule sets and the composite cleaner."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T
from ..functions.common import is_blank, trim_all


@dataclass
class Rules:
    """Merged cleaning rules; a config that is None switches its step off."""

    artifacts: list[str] = field(default_factory=list)
    fields: list[str] = field(default_factory=list)
    signatures: list[str] = field(default_factory=list)
    dates: list[str] = field(default_factory=list)
    spacing: str | None = None
    spacing_on: bool = False
    table: str | None = None
    repeated: tuple[int, int] | None = None  # threshold, least length


def merge_rules(sets: DataFrame) -> DataFrame:
    """One row from (position, enabled, <array columns>, <other columns>): arrays united in order without repeats, of other columns the
    last that is not null. Disabled sets are skipped."""
    on = sets.where("enabled")
    arrays = [c for c, t in sets.dtypes if t.startswith("array")]
    scalars = [c for c, t in sets.dtypes if not t.startswith("array") and c not in ("position", "enabled")]
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("position", F.col(c).alias("v")))), lambda x: F.coalesce(x["v"], F.array().cast("array<string>")))
    united = [F.array_distinct(F.flatten(listed(c))).alias(c) for c in arrays]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("position"))).alias(c) for c in scalars]
    return on.agg(F.count(F.lit(1)).alias("n_sets"), *united, *last)


def remove_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = 3, least: int = 20) -> DataFrame:
    """The relational form of the repeated-line step, for texts of any number of lines: (key, cleaned)."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("p", "line")).withColumn("k", trim_all(F.col("line")))
    same = W.partitionBy(key, "k")
    many = (F.count(F.lit(1)).over(same) >= threshold) & (F.length("k") >= least)
    lines = lines.withColumn("many", many).withColumn("later", F.col("many") & (F.row_number().over(same.orderBy("p")) > 1))
    kept = F.array_sort(F.collect_list(F.when(~F.col("later"), F.struct("p", "line"))))
    return lines.groupBy(key).agg(kept.alias("kept"), F.bool_or("many").alias("any_")).select(key, F.concat(F.array_join(F.transform("kept", lambda x: x["line"]), "\n"), F.when(F.col("any_"), "\n").otherwise("")).alias("cleaned"))


def steps(rules: Rules) -> list[tuple[str, Column, callable]]:
    """(name, whether it applies to a text, step) in their fixed order."""
    yes, t = F.lit(True), F.col("_text")
    out = [("UnicodeNormalization", yes, T.normalize_unicode)]
    if rules.artifacts or rules.fields or rules.signatures or rules.dates:
        out.append(("FormArtifactRemoval", yes, lambda c: T.remove_form_artifacts(c, rules.dates, rules.signatures, rules.fields, rules.artifacts)))
    if rules.spacing_on:
        out.append(("WordSpacingFix", yes, lambda c: T.fix_word_spacing(c, rules.spacing)))
    out.append(("WhitespaceNormalization", yes, T.normalize_whitespace))
    if rules.repeated:
        out.append(("RepetitiveContentRemoval", yes, lambda c: T.remove_repeated_lines(c, *rules.repeated)))
    if rules.table:
        out.append(("TableFormattingCleanup", F.contains(t, F.lit("|")), lambda c: T.clean_tables(c, rules.table)))
    out.append(("FinalCleanup", yes, T.finish))
    return out


def clean(docs: DataFrame, rules: Rules, text: str = "text") -> DataFrame:
    """``docs`` with cleaned, applied (names), chars_before, chars_after and reduction (percent)."""
    out = docs.withColumn("_text", F.when(is_blank(F.col(text)), "").otherwise(F.col(text))).withColumn("applied", F.array().cast("array<string>"))
    filled = F.col("_text") != ""
    for name, applies, step in steps(rules):
        out = out.withColumn("applied", F.when(filled & applies, F.concat("applied", F.array(F.lit(name)))).otherwise(F.col("applied")))
        out = out.withColumn("_text", F.when(applies, step(F.col("_text"))).otherwise(F.col("_text")))
    before = F.coalesce(F.length(text), F.lit(0))
    reduction = F.when(before > 0, F.round((before - F.length("cleaned")) * 100.0 / before, 6)).otherwise(0.0)
    return out.withColumnRenamed("_text", "cleaned").withColumn("chars_before", before).withColumn("chars_after", F.length("cleaned")).withColumn("reduction", reduction)


def tag_rejects(docs: DataFrame, text: str = "text", cleaned: str = "cleaned") -> DataFrame:
    """``docs`` with the reason of a rejection, null for accepted ones: blank extracted text, blank cleaned text."""
    reason = F.when(is_blank(F.col(text)), "no text extracted").when(is_blank(F.col(cleaned)), "no text after cleaning")
    # A generator: a filter on its output stays above it, where one on a plain column would be pushed down and repeat the whole cleaner.
    return docs.drop("reason").select("*", F.explode(F.array(reason)).alias("reason"))


def split_rejects(docs: DataFrame, text: str = "text", cleaned: str = "cleaned") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason) of :func:`tag_rejects`; each of the two cleans on its own."""
    tagged = tag_rejects(docs, text, cleaned)
    return tagged.where("reason is null").drop("reason"), tagged.where("reason is not null")
