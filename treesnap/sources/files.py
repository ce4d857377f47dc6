"""Directory trees as a Spark data source: ``spark.read.format("tree")``.

Yields (project, path, content BINARY) for every regular file under a root
folder, paths POSIX and relative to the root, hidden files and names
starting with '_' included (Spark's file sources skip those). Include and
exclude patterns are applied before any file is read, and so are filters on
``project`` and ``path`` in the query: equality, lists and prefixes reach the
source, which walks and opens what they leave. With content "hash" it gives
(project, path, sha256, n_bytes, n_lines) instead, read in small pieces, so that no
file's content ever forms a row.

Partitioning: the driver lists only top-level entries (of the root, or of each
project folder with layout "projects"); each
partition walks one of them on an executor. With ``read_tree(tasks=n)`` the
files are listed that way once and read by n tasks. The root must be on storage every executor sees.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass

import pandas as pd
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, StringStartsWith
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from treesnap.functions.globs import compile_patterns, selected

SCHEMA = StructType([StructField("project", StringType()), StructField("path", StringType()),
                     StructField("content", BinaryType())])
HASH_SCHEMA = StructType([StructField("project", StringType()), StructField("path", StringType()), StructField("sha256", StringType()),
                          StructField("n_bytes", LongType()), StructField("n_lines", LongType())])
PIECE = 65_536   # bytes hashed at once


@dataclass
class TreePartition(InputPartition):
    project: str        # project folder ('' in single-project layout)
    entry: str          # top-level entry of the project, '' = its loose files


def _selector(include: list[str], exclude: list[str]):
    inc, exc = compile_patterns(include), compile_patterns(exclude)
    return lambda path: selected(inc, path) and not (exc and selected(exc, path))


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["root"]
        self.project = options.get("project") or os.path.basename(os.path.normpath(self.root))
        self.include = json.loads(options.get("include", '["**/*"]'))
        self.exclude = json.loads(options.get("exclude", "[]"))
        self.content = options.get("content", "true")
        self.wanted: dict[str, set] = {}    # pushed filters: the values that a column may have,
        self.prefixes: list[str] = []       # and what the path begins with
        self.unreadable = options.get("unreadable", "fail")
        self.multi = options.get("layout", "single") == "projects"
        if not os.path.isdir(self.root):
            raise NotADirectoryError(f"Scan root is not a directory: {self.root}")

    def pushFilters(self, filters):
        """Filters on project and path that this source applies by itself;
        the others go back to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ("project", "path") and isinstance(f, (EqualTo, EqualNullSafe)) and isinstance(f.value, str):
                self._only(column, {f.value})
            elif column in ("project", "path") and isinstance(f, In):
                self._only(column, {v for v in f.value if isinstance(v, str)})
            elif column == "path" and isinstance(f, StringStartsWith):
                self.prefixes.append(f.value)
            else:
                yield f

    def _only(self, column: str, values: set) -> None:
        self.wanted[column] = self.wanted.get(column, values) & values

    def _fits(self, path: str) -> bool:
        return path in self.wanted.get("path", (path,)) and all(path.startswith(p) for p in self.prefixes)

    def _entry_fits(self, entry: str) -> bool:
        """Whether a top-level folder can hold a wanted path."""
        inside = entry + "/"
        return (any(p.startswith(inside) for p in self.wanted.get("path", (inside,)))
                and all(inside.startswith(p) or p.startswith(inside) for p in self.prefixes))

    def _project_dirs(self):
        names = self.wanted.get("project")
        if not self.multi:
            return [("", self.root)] if names is None or self.project in names else []
        return [(e.name, e.path) for e in sorted(os.scandir(self.root), key=lambda e: e.name)
                if e.is_dir(follow_symlinks=True) and (names is None or e.name in names)]

    def partitions(self):
        parts = []
        for name, pdir in self._project_dirs():
            entries = sorted(e.name for e in os.scandir(pdir) if e.is_dir(follow_symlinks=True) and self._entry_fits(e.name))
            parts += [TreePartition(name, e) for e in ["", *entries]]
        return parts

    @staticmethod
    def _files(base: str, entry: str):
        if entry == "":
            for e in os.scandir(base):
                if e.is_file(follow_symlinks=True):
                    yield e.name
            return
        for dirpath, _dirs, names in os.walk(os.path.join(base, entry), followlinks=False):
            rel_dir = os.path.relpath(dirpath, base).replace(os.sep, "/")
            for n in names:
                if os.path.isfile(os.path.join(dirpath, n)):
                    yield f"{rel_dir}/{n}"

    def read(self, partition: TreePartition | None):
        if partition is None:   # no partition at all
            return
        keep = _selector(self.include, self.exclude)
        base = os.path.join(self.root, partition.project) if self.multi else self.root
        project = partition.project if self.multi else self.project
        for rel in self._files(base, partition.entry):
            if self._fits(rel) and keep(rel):
                full = os.path.join(base, rel)
                if self.content == "hash":
                    yield (project, rel, *hash_file(full, self.unreadable))
                else:
                    yield (project, rel, None if self.content == "false" else read_file(full, self.unreadable))


def read_file(path: str, unreadable: str) -> bytes | None:
    try:
        with open(path, "rb") as fh:
            return fh.read()
    except OSError:
        if unreadable == "fail":
            raise
        return None  # reported as a file without content


def hash_file(path: str, unreadable: str) -> tuple[str | None, int | None, int | None]:
    """sha256, bytes and lines of a file, read piece by piece."""
    digest, size, breaks = hashlib.sha256(), 0, 0
    try:
        with open(path, "rb") as fh:
            while piece := fh.read(PIECE):
                digest.update(piece)
                size, breaks = size + len(piece), breaks + piece.count(b"\n")
    except OSError:
        if unreadable == "fail":
            raise
        return None, None, None
    return digest.hexdigest(), size, breaks + 1


class TreeDataSource(DataSource):
    """Options: root (required); layout 'single' (root is one project, named
    by ``project`` or the folder name) or 'projects' (each folder under root
    is a project); include / exclude (JSON lists of gitignore-style
    patterns); content 'false' to list only, 'hash' for hashes and counts; unreadable 'fail' (default) or 'null', which gives
    files that cannot be read a null content."""

    @classmethod
    def name(cls):
        return "tree"

    def schema(self):
        return HASH_SCHEMA if self.options.get("content") == "hash" else SCHEMA

    def reader(self, schema):
        return TreeReader(self.options)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeDataSource)


def read_tree(spark, root: str, include=("**/*",), exclude=(), project: str | None = None, tasks: int = 0,
              multi: bool = False, unreadable: str = "fail"):
    """(project, path, content) of the files under ``root`` (one project, or
    one project per folder with ``multi=True``). One task reads each top-level
    entry; with ``tasks``, the files are listed once, dealt out by path to so
    many tasks and read there, so a folder with most files is split."""
    register(spark)
    r = (spark.read.format("tree").option("root", root).option("include", json.dumps(list(include)))
         .option("exclude", json.dumps(list(exclude))).option("content", "false" if tasks else "true")
         .option("layout", "projects" if multi else "single").option("unreadable", unreadable))
    if project:
        r = r.option("project", project)
    if not tasks:
        return r.load()

    return fetch_files(r.load().repartition(tasks, "project", "path"), root, multi, unreadable)


def fetch_files(keys, root: str, multi: bool = False, unreadable: str = "fail"):
    """(project, path) -> (project, path, content): those files are opened and no others."""
    def fetch(batches):
        for pdf in batches:
            for p, rel in zip(pdf["project"], pdf["path"]):
                data = read_file(os.path.join(root, p, rel) if multi else os.path.join(root, rel), unreadable)
                yield pd.DataFrame({"project": [p], "path": [rel], "content": [data]})

    return keys.select("project", "path").mapInPandas(fetch, SCHEMA)


def tree_meta(spark, root: str, include=("**/*",), exclude=(), project: str | None = None, multi: bool = False, unreadable: str = "fail"):
    """(project, path, sha256, n_bytes, n_lines, sentences) of the files under
    ``root``, as ``changes.file_meta`` gives them, without their contents."""
    from pyspark.sql import functions as F

    from treesnap.functions.text import sentence_count
    register(spark)
    r = (spark.read.format("tree").option("root", root).option("include", json.dumps(list(include))).option("exclude", json.dumps(list(exclude)))
         .option("content", "hash").option("layout", "projects" if multi else "single").option("unreadable", unreadable))
    if project:
        r = r.option("project", project)
    lines = F.col("n_lines").cast("int")
    return r.load().select("project", "path", "sha256", "n_bytes", lines.alias("n_lines"), sentence_count(lines).alias("sentences"))


def write_tree(files, root: str) -> int:
    """Land a (project, path, content) table as files under
    ``root/<project>/<path>`` from the executors (root must be a folder every
    executor can write, such as a shared mount). Returns the file count."""
    if "://" in root or root.startswith("file:"):
        raise ValueError(f"{root}: files are written through the file system, give a mounted path")

    def run(batches):
        for pdf in batches:
            for project, path, content in zip(pdf["project"], pdf["path"], pdf["content"]):
                full = os.path.join(root, project, *path.split("/"))
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "wb") as fh:
                    fh.write(bytes(content))
            yield pd.DataFrame({"n": [len(pdf)]})

    out = files.select("project", "path", "content").mapInPandas(run, "n long")
    return int(out.groupBy().sum("n").first()[0] or 0)
