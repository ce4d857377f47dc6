"""Readers for per-project cache files in the reference's JSON layout, for
migrating existing caches into the parquet tables this package keeps.

* description cache: ``{"<path>": {"sha256": "...", "description": "..."}}``
* synthesis record: ``{"use_cases": "...", "conventions_ai": "..."}``

Each file belongs to one project; by default the project is the name of the
folder that holds the file's parent folder (``<project>/<dir>/cache.json``),
or give a regex whose first group extracts it from the file path. Files are
read whole (one row each). A path that matches nothing gives an empty table
with the right schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesnap.sources.snapshots import JSON_OPTIONS

CACHE_SCHEMA = "project string, path string, sha256 string, description string"
SYNTHESIS_SCHEMA = "project string, use_cases string, conventions_ai string"
DEFAULT_PROJECT_PATTERN = r"([^/]+)/[^/]+/[^/]+$"


def _files(spark: SparkSession, path: str, project_pattern: str, schema: str) -> DataFrame | None:
    """Parsed files; None where the path matches nothing. Any other trouble,
    a file that is no JSON object included, is an error."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop):
        return None
    raw = spark.read.text(path, wholetext=True)
    file = F.col("_metadata.file_path")
    bad = F.raise_error(F.concat(F.lit("no JSON object: "), file))
    return raw.select(F.regexp_extract(file, project_pattern, 1).alias("project"),
                      F.when(F.json_object_keys("value").isNotNull(), F.from_json("value", schema, JSON_OPTIONS)).otherwise(bad).alias("v"))


def read_description_cache(spark: SparkSession, path: str,
                           project_pattern: str = DEFAULT_PROJECT_PATTERN) -> DataFrame:
    """(project, path, sha256, description) from cache JSON files."""
    f = _files(spark, path, project_pattern, "map<string,struct<sha256:string,description:string>>")
    if f is None:
        return spark.createDataFrame([], CACHE_SCHEMA)
    e = f.select("project", F.explode("v").alias("path", "entry"))
    return e.select("project", "path", F.col("entry.sha256").alias("sha256"),
                    F.col("entry.description").alias("description"))


def read_synthesis(spark: SparkSession, path: str, project_pattern: str = DEFAULT_PROJECT_PATTERN) -> DataFrame:
    """(project, use_cases, conventions_ai) from synthesis JSON files."""
    f = _files(spark, path, project_pattern, "use_cases string, conventions_ai string")
    if f is None:
        return spark.createDataFrame([], SYNTHESIS_SCHEMA)
    return f.select("project", "v.use_cases", "v.conventions_ai").filter(
        F.col("use_cases").isNotNull() | F.col("conventions_ai").isNotNull())
