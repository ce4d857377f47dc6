"""Incremental change detection: hash files, look them up in the description
cache, select the misses, merge generated descriptions back, and gate the
project-level regeneration on the changed fraction.

Scale notes: ``files`` is (project, path, content). Only small columns
(keys, hash, line count) travel through the cache join; content is read for
cache misses only. The cache join is a shuffle on
(project, path), which spreads even a project holding a third of all files
over every partition. Per-project counts are partial (map-side) aggregates.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesnap.functions import text as T

# Fixed value: default fraction of changed files that triggers regeneration.
DEFAULT_THRESHOLD = 0.2

KEYS = ["project", "path"]


def file_meta(files: DataFrame) -> DataFrame:
    """(project, path, content) -> (project, path, sha256, n_bytes, n_lines,
    sentences). Hash over the raw bytes; line count over the decoded text."""
    text = T.utf8_text("content")
    n_lines = T.line_count(text)
    return files.select(
        "project", "path",
        T.sha256_hex("content").alias("sha256"),
        F.octet_length("content").cast("bigint").alias("n_bytes"),
        n_lines.alias("n_lines"),
        T.sentence_count(n_lines).alias("sentences"),
    )


def classify(meta: DataFrame, cache: DataFrame) -> DataFrame:
    """Cache lookup: a hit needs the same path and the same hash.
    status is 'hit', 'changed' (path known, hash differs) or 'new'."""
    c = cache.select(*KEYS, F.col("sha256").alias("cached_sha256"),
                     F.col("description").alias("cached_description"))
    j = meta.join(c, KEYS, "left")
    status = (F.when(F.col("cached_sha256").isNull(), F.lit("new"))
              .when(F.col("cached_sha256") != F.col("sha256"), F.lit("changed"))
              .otherwise(F.lit("hit")))
    return j.select(
        *meta.columns,
        status.alias("status"),
        F.when(status == "hit", F.col("cached_description")).alias("description"),
    )


def pending_keys(work: DataFrame) -> DataFrame:
    """Misses only: these and nothing else go to the description model."""
    return work.filter(F.col("status") != "hit").select(*KEYS, "sha256", "n_lines", "sentences", "status")


# Own wording; {path}, {content} and {sentences} are filled in per file.
DESCRIBE_TEMPLATE = ("Describe one file of a code base in {sentences} sentences: why it exists, what other files can "
                     "take from it, and what it depends on. Plain facts, no preamble.\n\nPath: {path}\n"
                     "----- content -----\n{content}\n----- end -----")


def fill(template: str, values: dict) -> F.Column:
    """A template with {names} as a column expression."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def describe_prompt(path, content, sentences, template: str = DESCRIBE_TEMPLATE):
    """The per-file prompt handed to a description model."""
    return fill(template, {"path": path, "content": content, "sentences": sentences})


def pending_work(files: DataFrame, work: DataFrame, template: str = DESCRIBE_TEMPLATE) -> DataFrame:
    """Misses joined to their content, with the decoded text and prompt.
    ``fresh`` is false where the content read now no longer has the hash that
    was classified: such a file is left to the next run."""
    j = files.select(*KEYS, "content").join(pending_keys(work), KEYS)
    text = T.utf8_text("content")
    return j.select(*KEYS, "sha256", "status", "n_lines", "sentences", text.alias("text"),
                    describe_prompt(F.col("path"), text, F.col("sentences"), template).alias("prompt"),
                    (T.sha256_hex("content") == F.col("sha256")).alias("fresh"))


def merge_descriptions(work: DataFrame, generated: DataFrame) -> DataFrame:
    """Hits keep the cached text; misses take the generated one (joined on
    project, path and the hash it was generated for)."""
    g = generated.select(*KEYS, "sha256", F.col("description").alias("generated"))
    j = work.join(g, KEYS + ["sha256"], "left")
    return j.select(*[c for c in work.columns if c != "description"],
                    F.coalesce(F.col("description"), F.col("generated")).alias("description"))


def miss_counts(work: DataFrame) -> DataFrame:
    """Per project: total files, misses (new + changed), and the split."""
    return work.groupBy("project").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("status") != "hit").alias("miss_files"),
        F.count_if(F.col("status") == "new").alias("new_files"),
        F.count_if(F.col("status") == "changed").alias("changed_files"),
    )


def regenerate_rule(miss, total, threshold, has_cached):
    """No stored synthesis -> regenerate; no files -> keep; else the changed
    fraction must reach the threshold (>=)."""
    return (F.when(~has_cached, F.lit(True))
            .when(total == 0, F.lit(False))
            .otherwise((miss / total) >= threshold))


def change_gate(counts: DataFrame, synthesis: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                force: bool = False) -> DataFrame:
    """One row per project that has files or a stored synthesis."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must be within [0, 1]")
    syn = synthesis.select("project").distinct().withColumn("has_cached", F.lit(True))
    j = counts.join(syn, "project", "full")
    total = F.coalesce(F.col("total_files"), F.lit(0)).cast("bigint")
    miss = F.coalesce(F.col("miss_files"), F.lit(0)).cast("bigint")
    has_cached = F.coalesce(F.col("has_cached"), F.lit(False))
    ratio = F.when(total > 0, miss / total)
    regen = F.lit(True) if force else regenerate_rule(miss, total, F.lit(threshold), has_cached)
    return j.select(
        "project",
        total.alias("total_files"), miss.alias("miss_files"),
        F.coalesce(F.col("new_files"), F.lit(0)).cast("bigint").alias("new_files"),
        F.coalesce(F.col("changed_files"), F.lit(0)).cast("bigint").alias("changed_files"),
        ratio.alias("change_ratio"), has_cached.alias("has_cached"), regen.alias("regenerate"),
    )
