"""Project-level synthesis: prompts and calls, only for gated projects.

A project's material (its tree lines, then its ``path: description`` lines) is
cut into parts of about ``part_chars`` characters by one rule for every
project, so no line is left out and no prompt grows with the project. A model
answers each part; a project's answers are combined in rounds of at most
``merge_parts`` answers per call until one is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesnap.functions import paths as P
from treesnap.functions.text import py_strip
from treesnap.operators.changes import fill
from treesnap.operators.describe import SYNTH_MAX_TOKENS, call_model
from treesnap.operators.ranges import running_total
from treesnap.session import materialize

PART_CHARS = 200_000
MERGE_PARTS = 32

# Own wording; the names in braces are filled in.
CONTEXT = "Project {project}, part {part} of {parts} of its files.\n\n{material}\n\n"
INSTRUCTIONS = "Instructions from the owners:\n{instructions}\n\n"
USER_CONVENTIONS = "Conventions the owners wrote down:\n{user_conventions}\n\n"
USE_CASES_ASK = ("From these files alone, draw who uses the software and for what, as a Mermaid chart "
                 "that begins with the line 'graph LR'. Answer with the chart only.")
CONVENTIONS_ASK = "List, as short bullets, how the code in these files is laid out and written, naming examples."
CONVENTIONS_NEW_ONLY = " Leave out what the owners already wrote down."
MERGE = "Project {project}. These answers come from parts of its files:\n\n{answers}\n\nCombine them into one answer to: {ask}"

TREE_HEAD, FILES_HEAD = "Folders and files:", "What the files are:"


def material(gate: DataFrame, tree_lines: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(project, kind, key, line) of the gated projects, in the order of kind
    and key: heading, tree, heading, descriptions."""
    regen = gate.filter("regenerate").select("project")
    none = F.array().cast("array<string>")
    heads = regen.select("project", F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), none.alias("key"), F.lit(t).alias("line")) for k, t in ((0, TREE_HEAD), (2, FILES_HEAD))]))
        .alias("h")).select("project", "h.*")
    tree = tree_lines.join(regen, "project", "left_semi").select(
        "project", F.lit(1).alias("kind"), F.when(F.col("node_path") == "", none).otherwise(P.parts("node_path")).alias("key"), "line")
    files = descriptions.join(regen, "project", "left_semi").select(
        "project", F.lit(3).alias("kind"), F.array("path").alias("key"),
        F.concat("path", F.lit(": "), F.coalesce("description", F.lit(""))).alias("line"))
    return heads.unionByName(tree).unionByName(files)


def prompts(gate: DataFrame, tree_lines: DataFrame, descriptions: DataFrame, instructions: str = "",
            user_conventions: str = "", part_chars: int = PART_CHARS) -> DataFrame:
    """(project, part, parts, use_cases_prompt, conventions_prompt). A line
    belongs to the part in which it starts; a longer line is not cut."""
    placed = running_total(material(gate, tree_lines, descriptions), "project", ["kind", "key"],
                           F.length("line") + 1, "at")
    part = F.floor(F.col("at") / part_chars)
    body = placed.groupBy("project", part.alias("n")).agg(
        F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))  # part_chars bounds a group
    body = body.select("project", "n", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("material"))
    # a long line may leave part numbers empty: count the parts there are
    listed = body.groupBy("project").agg(F.array_sort(F.collect_list("n")).alias("all"))
    j = body.join(listed, "project")
    values = {"project": F.col("project"), "part": F.array_position("all", F.col("n")), "parts": F.size("all"),
              "material": F.col("material"), "instructions": F.lit(instructions), "user_conventions": F.lit(user_conventions)}
    head = CONTEXT + (INSTRUCTIONS if instructions.strip() else "")
    own = USER_CONVENTIONS if user_conventions.strip() else ""
    return j.select("project", values["part"].cast("int").alias("part"), values["parts"].alias("parts"),
                    fill(head + USE_CASES_ASK, values).alias("use_cases_prompt"),
                    fill(CONTEXT + own + CONVENTIONS_ASK + (CONVENTIONS_NEW_ONLY if own else ""), values).alias("conventions_prompt"))


def synthesize_with(prompt_rows: DataFrame, complete: Callable[[list[str], int], list[str]], tasks: int = 10,
                    merge_parts: int = MERGE_PARTS, ask: Callable = call_model) -> DataFrame:
    """(project, use_cases, conventions_ai, error): the model answers every
    part, then combines the answers. A project of which a call failed has an
    error and no texts, so its stored synthesis stays. ``ask`` is the way to
    the model, as for ``describe_with``."""
    asks = F.array(F.struct(F.lit("use_cases").alias("what"), F.col("use_cases_prompt").alias("prompt")),
                   F.struct(F.lit("conventions_ai").alias("what"), F.col("conventions_prompt").alias("prompt")))
    calls = prompt_rows.select("project", "part", F.explode(asks).alias("a")).select("project", "part", "a.what", "a.prompt")
    done = materialize(ask(calls, complete, SYNTH_MAX_TOKENS, tasks), "part-answers")
    while not done.where("part > 1").isEmpty():
        wording = {"use_cases": USE_CASES_ASK, "conventions_ai": CONVENTIONS_ASK}
        wanted = F.create_map(*[F.lit(x) for kv in wording.items() for x in kv])[F.col("what")]
        group = F.ceil(F.col("part") / merge_parts).cast("int").alias("part")
        g = done.groupBy("project", "what", group).agg(
            F.array_sort(F.collect_list(F.struct(F.col("part").alias("p"), "answer"))).alias("xs"), F.max("error").alias("error"))
        text = F.array_join(F.transform("xs", lambda x: x["answer"]), "\n\n")
        failed = g.where("error is not null").select("project", "part", "what", F.lit(None).cast("string").alias("answer"), "error")
        single = g.where("error is null and size(xs) = 1").select("project", "part", "what", text.alias("answer"), "error")
        several = g.where("error is null and size(xs) > 1").select(
            "project", "part", "what", fill(MERGE, {"project": F.col("project"), "answers": text, "ask": wanted}).alias("prompt"))
        done = materialize(failed.unionByName(single).unionByName(ask(several, complete, SYNTH_MAX_TOKENS, tasks)), "merged-answers")
    pick = lambda what: F.max(F.when(F.col("what") == what, F.col("answer")))
    out = done.groupBy("project").agg(pick("use_cases").alias("u"), pick("conventions_ai").alias("c"), F.max("error").alias("error"))
    ok = F.col("error").isNull()
    return out.select("project", F.when(ok, py_strip("u")).alias("use_cases"), F.when(ok, py_strip("c")).alias("conventions_ai"), "error")
