"""Snapshot documents: parse pushed JSON (one document per row) and validate.

A document is the nested JSON a build writes for one project:
metadata{name, generated_at, file_count}, instructions, use_cases,
conventions{user, ai}, file_tree, architecture, files{path: description}.
``file_tree`` and ``architecture`` may be one string or an array of lines
(the form this package's writer uses); both read the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treesnap.session import materialize

# Rejection reasons (the reference answers 400 / 422).
INVALID_JSON = "Invalid JSON body"
MISSING_NAME = "Missing metadata.name"


# Strings may be as long as a row can hold.
JSON_OPTIONS = {"maxStringLen": str(2**31 - 1), "allowUnquotedControlChars": "false"}
_TEXTS = "file_tree string, architecture string"
SCHEMA = ("metadata struct<name string, generated_at string, file_count string>, instructions string, use_cases string, "
          f"conventions struct<user string, ai string>, {_TEXTS}, files map<string,string>")
LINES_SCHEMA = _TEXTS.replace("string", "array<string>")


def parse(raw: DataFrame, value: str = "value") -> DataFrame:
    """Rows with a JSON text column -> typed snapshot columns plus
    ``error`` (NULL for accepted documents). Other input columns are kept.
    Of a repeated key the last value counts. Long documents and strings are
    read like short ones; a row's 2 GB are the only limit."""
    keep = [c for c in raw.columns if c != value]
    v = F.col(value)
    parsed = raw.select(*keep, v.alias("_v"), F.from_json(v, SCHEMA, JSON_OPTIONS).alias("_d"))
    d = F.col("_d")
    # looked at again only where an array of lines may stand, or no metadata was found
    listed = F.when((F.left(d["file_tree"], F.lit(1)) == "[") | (F.left(d["architecture"], F.lit(1)) == "["), F.from_json("_v", LINES_SCHEMA, JSON_OPTIONS))
    bad = F.when(d["metadata"].isNull(), F.json_object_keys("_v").isNull())
    parsed = parsed.select(*keep, "_d", listed.alias("_l"), bad.alias("_bad"))
    name = d["metadata"]["name"]
    error = F.when(F.col("_bad"), F.lit(INVALID_JSON)).when(name.isNull() | (name == ""), F.lit(MISSING_NAME))

    def text(field: str) -> F.Column:
        return F.coalesce(F.array_join(F.col("_l")[field], "\n"), d[field])
    return parsed.select(
        *keep, name.alias("project"), d["metadata"]["generated_at"].alias("generated_at"),
        F.expr("try_cast(_d.metadata.file_count as int)").alias("file_count"), d["instructions"].alias("instructions"),
        d["use_cases"].alias("use_cases"), d["conventions"]["user"].alias("conventions_user"),
        d["conventions"]["ai"].alias("conventions_ai"), text("file_tree").alias("file_tree"),
        text("architecture").alias("architecture"), d["files"].alias("files"), error.alias("error"))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNull()).drop("error")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNotNull())


def read_documents(spark, path: str, json_lines: bool = True) -> DataFrame:
    """Read pushed documents from a landing folder: JSON Lines (one document
    per line) or whole files (one document per file). Adds the file name and
    modification time used to order pushes."""
    reader = spark.read.format("text")
    if not json_lines:
        reader = reader.option("wholetext", True)
    df = reader.load(path)
    return df.select("value", F.col("_metadata.file_path").alias("source_file"),
                     F.col("_metadata.file_modification_time").alias("pushed_at"))


def read_built(spark, path: str) -> DataFrame:
    """The documents that a build wrote under ``path`` (project=<name>/part
    files), one row per project as (value, project_folder): the parts of a
    folder in name order. A document is one row, as it is one push."""
    parts = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").text(path, wholetext=True)
             .select("value", F.col("_metadata.file_path").alias("file")))
    folder = F.regexp_extract("file", r"project=([^/]*)/[^/]*$", 1)
    g = parts.groupBy(folder.alias("project_folder")).agg(F.array_sort(F.collect_list(F.struct("file", "value"))).alias("xs"))
    return g.select(F.array_join(F.transform("xs", lambda x: x["value"]), "").alias("value"), "project_folder")


@dataclass
class Built:
    """A build's documents as rows, whatever their size."""
    fields: DataFrame   # project, field, value: the single texts, a few rows per project
    files: DataFrame    # project, path, description
    texts: DataFrame    # project, field (file_tree or architecture), part, block, n, line


_ARRAYS, _MAPS = ("file_tree", "architecture"), ("metadata", "conventions", "files")


def _pair(line: Column) -> Column:
    """The key and value of a line that is one JSON pair."""
    body = F.regexp_replace(F.ltrim(line), ",$", "")
    return F.element_at(F.map_entries(F.from_json(F.concat(F.lit("{"), body, F.lit("}")), "map<string,string>", JSON_OPTIONS)), 1)


def read_built_rows(spark, path: str) -> Built:
    """The documents that a build wrote under ``path``, line by line: no
    document is put together. Each line belongs to the section whose opening line
    is the last one before it, in the order of part files and places; a project has
    seven such lines at most, and they are joined to its other lines. Both forms of
    the text fields read the same; a whole string is one text line."""
    folder = F.regexp_extract("file", r"project=([^/]*)/[^/]*$", 1)
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").option("lineSep", "\n").text(path)
             .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
             .withColumn("n", F.monotonically_increasing_id()).where(F.col("value").startswith('  "') | F.col("value").startswith("    ")))
    part = F.regexp_extract("file", r"([^/]+)$", 1)
    lines = materialize(lines.select(plain(plain(folder)).alias("project"), part.alias("part"), "block", "n", "value"), "built-lines")
    place = F.struct("part", "block", "n")
    opens = lines.where(F.col("value").startswith('  "')).withColumn("section", F.regexp_extract("value", r'^  "([a-z_]+)":', 1))
    single = opens.where(~F.col("section").isin(*_MAPS) & ~F.col("value").endswith("["))
    marks = materialize(opens.groupBy("project").agg(F.collect_list(F.struct(place.alias("place"), "section")).alias("marks")), "built-sections")
    own = F.array_max(F.filter("marks", lambda m: m["place"] < place))["section"]
    items = lines.where(F.col("value").startswith("    ")).join(marks, "project").select("project", "part", "block", "n", "value", own.alias("section"))
    pairs = items.where(F.col("section").isin(*_MAPS)).select("project", "section", _pair(F.col("value")).alias("p")).select("project", "section", "p.key", "p.value")
    files = pairs.where("section = 'files'").select("project", F.col("key").alias("path"), F.col("value").alias("description"))
    field = F.when(F.col("section") == "conventions", F.concat(F.lit("conventions_"), "key")).otherwise(F.col("key"))
    alone = single.select("project", "section", "part", "block", "n", _pair(F.col("value"))["value"].alias("text"))
    fields = pairs.where("section <> 'files'").select("project", field.alias("field"), "value").unionByName(
        alone.where(~F.col("section").isin(*_ARRAYS)).select("project", F.col("section").alias("field"), F.col("text").alias("value")))
    listed = F.get(F.from_json(F.concat(F.lit("["), F.regexp_replace("value", ",$", ""), F.lit("]")), "array<string>", JSON_OPTIONS), F.lit(0))
    texts = items.where(F.col("section").isin(*_ARRAYS)).select("project", F.col("section").alias("field"), "part", "block", "n", listed.alias("line")).unionByName(
        alone.where(F.col("section").isin(*_ARRAYS)).select("project", F.col("section").alias("field"), "part", "block", "n", F.col("text").alias("line")))
    return Built(fields, files, texts)
