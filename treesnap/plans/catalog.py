"""Registered queries over the driver tables, each with its DuckDB oracle SQL.

Every query reads whole tables (``documents``, ``pages``, ``embeddings``,
``conversations``, ``benchmark``, ``labels``, ``part``) and derives its inputs
from them by fixed rules (see ``treesnap.sources.tables``). Column names are
aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesnap.operators import changes
from treesnap.sources import tables as TB

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- SQL pieces
DOC_PATH = "(source || '/' || lang || '/doc_' || CAST(doc_id AS VARCHAR) || '.txt')"
N_LINES = "CAST(strlen(text) - strlen(replace(text, chr(10), '')) + 1 AS INTEGER)"
SENTENCES = "(CASE WHEN {n} < 30 THEN 2 WHEN {n} < 150 THEN 4 ELSE 6 END)"
SENTENCE_RE = r"[^.!?\t\n\x0b\f\r ][^.!?]*(?:[.!?]+|\z)"

SQL_FILES = f"""
  SELECT source AS project, {DOC_PATH} AS path, text, sha256(text) AS sha256,
         {N_LINES} AS n_lines
  FROM documents"""
SQL_CACHE = f"""
  SELECT source AS project, {DOC_PATH} AS path,
         CASE WHEN doc_id % 7 = 0 THEN sha256(text || ' (old)') ELSE sha256(text) END AS sha256,
         'Cached description of ' || {DOC_PATH} || '.' AS description
  FROM documents WHERE doc_id % 5 <> 0"""
SQL_WORK = f"""
  WITH f AS ({SQL_FILES}), c AS ({SQL_CACHE})
  SELECT f.project, f.path, f.text, f.sha256, f.n_lines,
         {SENTENCES.format(n='f.n_lines')} AS sentences,
         CASE WHEN c.sha256 IS NULL THEN 'new' WHEN c.sha256 <> f.sha256 THEN 'changed'
              ELSE 'hit' END AS status,
         CASE WHEN c.sha256 = f.sha256 THEN c.description END AS cached_description
  FROM f LEFT JOIN c ON f.project = c.project AND f.path = c.path"""


# ------------------------------------------------------------ shared Spark
def _documents(spark, sf_dir):
    return TB.table(spark, sf_dir, "documents")


def _work(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    files = TB.files_from_documents(docs)
    cache = TB.previous_cache(docs)
    return files, cache, changes.classify(changes.file_meta(files), cache)


# ------------------------------------------------------ 1. change detection
@register("file_meta", f"""
  SELECT source AS project, {DOC_PATH} AS path, sha256(text) AS sha256,
         CAST(strlen(text) AS BIGINT) AS n_bytes, {N_LINES} AS n_lines,
         {SENTENCES.format(n=N_LINES)} AS sentences
  FROM documents""")
def q_file_meta(spark, sf_dir):
    return changes.file_meta(TB.files_from_documents(_documents(spark, sf_dir)))


@register("change_status", f"""
  WITH w AS ({SQL_WORK})
  SELECT project, path, sha256, status, cached_description AS description FROM w""")
def q_change_status(spark, sf_dir):
    _, _, work = _work(spark, sf_dir)
    return work.select("project", "path", "sha256", "status", "description")


def template_sql(template: str, values: dict[str, str]) -> str:
    """A template with {names} as a SQL expression."""
    import re
    parts = re.split(r"\{(\w+)\}", template)
    quote = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return " || ".join(values[x] if i % 2 else quote(x) for i, x in enumerate(parts))


PROMPT_SQL = template_sql(changes.DESCRIBE_TEMPLATE, {"path": "path", "content": "text", "sentences": "CAST(sentences AS VARCHAR)"})


@register("pending_work", f"""
  WITH w AS ({SQL_WORK})
  SELECT project, path, sha256, status, n_lines, sentences, {PROMPT_SQL} AS prompt
  FROM w WHERE status <> 'hit'""")
def q_pending_work(spark, sf_dir):
    files, _, work = _work(spark, sf_dir)
    p = changes.pending_work(files, work)
    return p.select("project", "path", "sha256", "status", "n_lines", "sentences", "prompt")


@register("change_gate", f"""
  WITH w AS ({SQL_WORK}),
  counts AS (
    SELECT project, COUNT(*) AS total_files,
           COUNT(*) FILTER (WHERE status <> 'hit') AS miss_files,
           COUNT(*) FILTER (WHERE status = 'new') AS new_files,
           COUNT(*) FILTER (WHERE status = 'changed') AS changed_files
    FROM w GROUP BY project),
  syn AS (SELECT DISTINCT project, TRUE AS has_cached FROM ({SQL_CACHE}))
  SELECT COALESCE(counts.project, syn.project) AS project,
         CAST(COALESCE(total_files, 0) AS BIGINT) AS total_files,
         CAST(COALESCE(miss_files, 0) AS BIGINT) AS miss_files,
         CAST(COALESCE(new_files, 0) AS BIGINT) AS new_files,
         CAST(COALESCE(changed_files, 0) AS BIGINT) AS changed_files,
         CASE WHEN COALESCE(total_files, 0) > 0 THEN miss_files / total_files END AS change_ratio,
         COALESCE(has_cached, FALSE) AS has_cached,
         CASE WHEN NOT COALESCE(has_cached, FALSE) THEN TRUE
              WHEN COALESCE(total_files, 0) = 0 THEN FALSE
              ELSE COALESCE(miss_files, 0) / total_files >= 0.2 END AS regenerate
  FROM counts FULL OUTER JOIN syn ON counts.project = syn.project""")
def q_change_gate(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    files = TB.files_from_documents(docs)
    cache = TB.previous_cache(docs)
    work = changes.classify(changes.file_meta(files), cache)
    return changes.change_gate(changes.miss_counts(work), TB.previous_synthesis(cache))


# ------------------------------------------------------- 2. paths and globs
from treesnap.functions import globs as G  # noqa: E402
from treesnap.functions import paths as P  # noqa: E402
from treesnap.functions.imports import HREF_PATTERN, JS_IMPORT_PATTERN  # noqa: E402
from treesnap.functions.text import PY_WS_CLASS  # noqa: E402
from treesnap.operators import deps as D  # noqa: E402
from treesnap.operators import tree as TR  # noqa: E402

GLOB_INCLUDE = ["**/*.txt", "!src1*/", "src1/", "!**/es/doc_*0.txt"]
GLOB_EXCLUDE = ["de/", "doc_1?.txt", "es/doc_[0-4]*"]


@register("glob_filter", f"""
  WITH f AS (SELECT source AS project, {DOC_PATH} AS path FROM documents),
  m AS (SELECT project, path,
    CASE WHEN regexp_matches(path, '^(?:.+/)?es/doc_[^/]*0\\.txt(?:/.*)?$') THEN FALSE
         WHEN regexp_matches(path, '^(?:.+/)?src1/.*$') THEN TRUE
         WHEN regexp_matches(path, '^(?:.+/)?src1[^/]*/.*$') THEN FALSE
         WHEN regexp_matches(path, '^(?:.+/)?[^/]*\\.txt(?:/.*)?$') THEN TRUE ELSE FALSE END AS inc,
    CASE WHEN regexp_matches(path, '^es/doc_[0-4][^/]*(?:/.*)?$') THEN TRUE
         WHEN regexp_matches(path, '^(?:.+/)?doc_1[^/]\\.txt(?:/.*)?$') THEN TRUE
         WHEN regexp_matches(path, '^(?:.+/)?de/.*$') THEN TRUE ELSE FALSE END AS exc
    FROM f)
  SELECT project, path FROM m WHERE inc AND NOT exc""")
def q_glob_filter(spark, sf_dir):
    files = TB.files_from_documents(_documents(spark, sf_dir)).select("project", "path")
    return files.filter(G.select_paths("path", GLOB_INCLUDE, GLOB_EXCLUDE))


URL_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?([^?#]*)', 1)"


@register("path_parts", f"""
  WITH u AS (SELECT page_id, {URL_PATH} AS path FROM pages),
  s AS (SELECT page_id, path, string_split(path, '/') AS parts FROM u)
  SELECT page_id, path,
         array_to_string(parts[1:len(parts) - 1], '/') AS parent,
         parts[len(parts)] AS name,
         CAST(len(parts) AS INTEGER) AS depth,
         regexp_extract(parts[len(parts)], '^.+(\\.[^./]+)$', 1) AS suffix,
         translate(path, '/.-', '___') AS node_id,
         array_to_string(list_filter(parts, lambda x: x <> '' AND x <> '.'), '/') AS cleaned
  FROM s""")
def q_path_parts(spark, sf_dir):
    pages = TB.table(spark, sf_dir, "pages")
    u = pages.select("page_id", P.url_path("url").alias("path"))
    return u.select("page_id", "path", P.parent("path").alias("parent"), P.name("path").alias("name"),
                    P.depth("path").cast("int").alias("depth"), P.suffix("path").alias("suffix"),
                    P.node_id("path").alias("node_id"), P.clean("path").alias("cleaned"))


@register("slug", """
  WITH s AS (SELECT p_partkey, p_name,
                    regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s
             FROM part)
  SELECT p_partkey, p_name, CASE WHEN s = '' THEN 'default' ELSE s END AS slug FROM s""")
def q_slug(spark, sf_dir):
    part = TB.table(spark, sf_dir, "part")
    return part.select("p_partkey", "p_name", P.slug("p_name").alias("slug"))


# ------------------------------------------------------------------ 3. tree
SQL_PATHS = f"SELECT source AS project, {DOC_PATH} AS path FROM documents"
SQL_DIRS = """
  SELECT project, dir_path,
         array_to_string(string_split(dir_path, '/')[1:len(string_split(dir_path, '/')) - 1], '/') AS parent,
         string_split(dir_path, '/')[-1] AS name, CAST(depth AS INTEGER) AS depth
  FROM (SELECT project, array_to_string(string_split(path, '/')[1:level], '/') AS dir_path, min(level) AS depth
        FROM (SELECT project, path, unnest(generate_series(1, len(string_split(path, '/')) - 1)) AS level
              FROM ({paths}))
        GROUP BY 1, 2)"""


@register("dir_nodes", SQL_DIRS.format(paths=SQL_PATHS))
def q_dir_nodes(spark, sf_dir):
    paths = TB.files_from_documents(_documents(spark, sf_dir)).select("project", "path")
    return TR.dir_nodes(paths)


SQL_TREE_EDGES = """
  WITH p AS (SELECT project, path, string_split(path, '/') AS parts FROM ({paths})),
  e AS (SELECT project, path, parts, unnest(generate_series(0, len(parts) - 2)) AS pos FROM p),
  e2 AS (SELECT project, path, parts, pos,
           CASE WHEN pos = 0 THEN array_to_string(parts[1:len(parts) - 1], '/')
                ELSE array_to_string(parts[1:pos], '/') END AS parent_path,
           CASE WHEN pos = 0 THEN path ELSE array_to_string(parts[1:pos + 1], '/') END AS child_path
         FROM e),
  e3 AS (SELECT *, translate(parent_path, '/.-', '___') AS parent_id,
                translate(child_path, '/.-', '___') AS child_id FROM e2)
  SELECT project, parent_id, child_id,
         arg_min(parent_path, {{'k': parts, 'p': pos}}) AS parent_path,
         arg_min(child_path, {{'k': parts, 'p': pos}}) AS child_path,
         arg_min(path, {{'k': parts, 'p': pos}}) AS first_file,
         CAST(arg_min(pos, {{'k': parts, 'p': pos}}) AS INTEGER) AS first_pos
  FROM e3 GROUP BY project, parent_id, child_id"""


@register("tree_edges", SQL_TREE_EDGES.format(paths=SQL_PATHS))
def q_tree_edges(spark, sf_dir):
    paths = TB.files_from_documents(_documents(spark, sf_dir)).select("project", "path")
    return TR.tree_edges(paths)


@register("tree_lines", f"""
  WITH f AS ({SQL_PATHS}),
  nd AS (
    SELECT project, path AS node_path,
           array_to_string(string_split(path, '/')[1:len(string_split(path, '/')) - 1], '/') AS parent,
           string_split(path, '/')[-1] AS name, CAST(len(string_split(path, '/')) AS INTEGER) AS depth
    FROM f
    UNION ALL
    SELECT project, dir_path, parent, name, depth FROM ({SQL_DIRS.format(paths=SQL_PATHS)})),
  fl AS (SELECT *, name = max(name) OVER (PARTITION BY project, parent) AS is_last FROM nd),
  anc AS (SELECT project, node_path, unnest(generate_series(1, depth - 1)) AS level FROM fl),
  pre AS (
    SELECT a.project, a.node_path,
           string_agg(CASE WHEN x.is_last THEN '    ' ELSE '│   ' END, '' ORDER BY a.level) AS prefix
    FROM anc a JOIN fl x
      ON x.project = a.project
     AND x.node_path = array_to_string(string_split(a.node_path, '/')[1:a.level], '/')
    GROUP BY a.project, a.node_path)
  SELECT fl.project, fl.node_path, fl.depth,
         COALESCE(pre.prefix, '') || CASE WHEN fl.is_last THEN '└── ' ELSE '├── ' END || fl.name AS line
  FROM fl LEFT JOIN pre ON fl.project = pre.project AND fl.node_path = pre.node_path
  UNION ALL
  SELECT DISTINCT project, '' AS node_path, 0 AS depth, project || '/' AS line FROM f""")
def q_tree_lines(spark, sf_dir):
    paths = TB.files_from_documents(_documents(spark, sf_dir)).select("project", "path")
    return TR.tree_lines(paths)


# ---------------------------------------------------------- 4. dependencies
SQL_DEP_FILES = """
  SELECT lang AS project, source || '/doc_' || CAST(doc_id AS VARCHAR) || '.ts' AS path,
         'import a from ''../src' || CAST((doc_id * 7) % 20 AS VARCHAR) || '/doc_'
           || CAST((doc_id * 7) % (SELECT count(*) FROM documents) AS VARCHAR) || '''' || chr(10) || text
           AS content
  FROM documents"""
JS_PAT_SQL = JS_IMPORT_PATTERN.replace("'", "''")
SQL_RAW_DEPS = f"""
  SELECT project, path, unnest(deps) AS dep, unnest(generate_series(0, len(deps) - 1)) AS dep_ord
  FROM (SELECT project, path, regexp_extract_all(content, '{JS_PAT_SQL}', 1) AS deps FROM ({SQL_DEP_FILES}))"""


@register("import_extract", f"SELECT project, path, CAST(dep_ord AS INTEGER) AS dep_ord, dep FROM ({SQL_RAW_DEPS})")
def q_import_extract(spark, sf_dir):
    files = TB.dependency_files(_documents(spark, sf_dir))
    return D.raw_dependencies(files).select("project", "path", "dep_ord", "dep")


NORMALISE_SQL = """(CASE WHEN NOT r.up THEN array_to_string(r.st, '/') END)"""
SQL_DEP_EDGES = f"""
  WITH d AS ({SQL_RAW_DEPS}),
  b AS (SELECT project, path, dep_ord, dep,
          CASE WHEN starts_with(dep, '/') THEN regexp_replace(dep, '^/+', '')
               ELSE CASE WHEN array_to_string(string_split(path, '/')[1:len(string_split(path, '/')) - 1], '/') = ''
                         THEN dep
                         ELSE array_to_string(string_split(path, '/')[1:len(string_split(path, '/')) - 1], '/')
                              || '/' || dep END END AS base
        FROM d),
  c AS (SELECT project, path, dep_ord, dep,
          array_to_string(list_filter(string_split(base, '/'), lambda x: x <> '' AND x <> '.'), '/') AS cleaned
        FROM b),
  l AS (SELECT project, path, dep_ord, dep,
          CASE WHEN regexp_extract(string_split(cleaned, '/')[-1], '^.+(\\.[^./]+)$', 1) = ''
               THEN [cleaned, cleaned || '.ts', cleaned || '.tsx', cleaned || '.js', cleaned || '.jsx',
                     cleaned || '.py', cleaned || '/index.ts', cleaned || '/index.tsx', cleaned || '/index.js',
                     cleaned || '/index.jsx']
               ELSE [cleaned] END AS cands
        FROM c),
  u AS (SELECT project, path, dep_ord, dep, unnest(cands) AS cand,
               unnest(generate_series(0, len(cands) - 1)) AS prio FROM l),
  n AS (SELECT project, path, dep_ord, dep, prio,
          list_reduce(string_split(cand, '/'),
            lambda acc, x: CASE WHEN x = '' OR x = '.' THEN acc
                                WHEN x = '..' THEN (CASE WHEN len(acc.st) = 0 THEN {{'st': acc.st, 'up': TRUE}}
                                                         ELSE {{'st': acc.st[1:len(acc.st) - 1], 'up': acc.up}} END)
                                ELSE {{'st': list_append(acc.st, x), 'up': acc.up}} END,
            {{'st': []::VARCHAR[], 'up': FALSE}}) AS r
        FROM u),
  n2 AS (SELECT project, path, dep_ord, dep, prio, {NORMALISE_SQL} AS cand FROM n),
  fs AS (SELECT project, path AS cand FROM ({SQL_DEP_FILES})),
  res AS (SELECT n2.project, n2.path, n2.dep_ord, n2.dep, arg_min(n2.cand, n2.prio) AS target
          FROM n2 JOIN fs ON n2.project = fs.project AND n2.cand = fs.cand
          GROUP BY n2.project, n2.path, n2.dep_ord, n2.dep)
  SELECT project, path AS src_path, target AS dst_path,
         translate(path, '/.-', '___') AS src_id, translate(target, '/.-', '___') AS dst_id,
         CAST(min(dep_ord) AS INTEGER) AS dep_ord
  FROM res WHERE target <> path GROUP BY project, path, target"""


@register("dep_edges", SQL_DEP_EDGES)
def q_dep_edges(spark, sf_dir):
    files = TB.dependency_files(_documents(spark, sf_dir))
    return D.dependency_edges(files)


def _updated_tables(spark, sf_dir):
    """The derived tables of an earlier state of the dependency files (some
    not there yet, some with other content, some that are gone now), updated to
    the present one."""
    from treesnap.operators import incremental as INC
    from treesnap.session import materialize
    files = materialize(TB.dependency_files(_documents(spark, sf_dir)), "dependency-files")
    number = F.regexp_extract("path", r"doc_(\d+)\.ts$", 1).cast("bigint")
    earlier = files.where(number % 5 != 0).withColumn("path", F.when(number % 11 == 0, F.concat(F.lit("gone/"), "path")).otherwise(F.col("path")))
    earlier = earlier.withColumn("content", F.when(number % 7 == 0, F.lit("import a from './doc_1'").cast("binary")).otherwise(F.col("content")))
    first = INC.update(INC.Derived.empty(spark), changes.file_meta(earlier), INC.content_from(earlier))
    return INC.update(first, changes.file_meta(files), INC.content_from(files))


@register("incremental_edges", SQL_DEP_EDGES)
def q_incremental_edges(spark, sf_dir):
    """Dependency edges kept up to date: the oracle rebuilds them."""
    return _updated_tables(spark, sf_dir).edges()


@register("incremental_dirs", f"""
  SELECT project, string_split(path, '/')[1] AS dir_path, CAST(count(*) AS BIGINT) AS n_files FROM ({SQL_DEP_FILES}) GROUP BY 1, 2""")
def q_incremental_dirs(spark, sf_dir):
    """Directories with the number of files below them, kept up to date."""
    return _updated_tables(spark, sf_dir).dirs


@register("link_extract", f"""
  SELECT page_id, CAST(link_ord AS INTEGER) AS link_ord, link FROM (
    SELECT page_id, unnest(l) AS link, unnest(generate_series(0, len(l) - 1)) AS link_ord
    FROM (SELECT page_id, regexp_extract_all(html, '{HREF_PATTERN}', 1) AS l FROM pages))""")
def q_link_extract(spark, sf_dir):
    from treesnap.functions.imports import href_links
    pages = TB.table(spark, sf_dir, "pages")
    e = pages.select("page_id", F.posexplode_outer(href_links(F.col("html"))).alias("link_ord", "link"))
    return e.filter(F.col("link").isNotNull())


SQL_PY_FILES = """
  SELECT source AS project, lang || '/doc_' || CAST(doc_id AS VARCHAR) || '.py' AS path, lang, doc_id,
         (doc_id * 3) % (SELECT count(*) FROM documents) AS x, (doc_id * 3) % 20 AS k
  FROM documents"""


@register("py_imports", f"""
  SELECT project, path, CAST(dep_ord AS INTEGER) AS dep_ord, dep FROM (
    SELECT project, path, 0 AS dep_ord, 'os' AS dep FROM ({SQL_PY_FILES})
    UNION ALL SELECT project, path, 1, '.doc_' || CAST(x AS VARCHAR) FROM ({SQL_PY_FILES})
    UNION ALL SELECT project, path, 2, '..src' || CAST(k AS VARCHAR) FROM ({SQL_PY_FILES}))""")
def q_py_imports(spark, sf_dir):
    files = TB.python_files(_documents(spark, sf_dir))
    return D.raw_dependencies(files).select("project", "path", "dep_ord", "dep")


@register("py_dep_edges", f"""
  WITH f AS ({SQL_PY_FILES}),
  d AS (SELECT project, path, lang || '/doc_' || CAST(x AS VARCHAR) || '.py' AS cand FROM f)
  SELECT d.project, d.path AS src_path, d.cand AS dst_path, translate(d.path, '/.-', '___') AS src_id,
         translate(d.cand, '/.-', '___') AS dst_id, CAST(1 AS INTEGER) AS dep_ord
  FROM d JOIN f ON f.project = d.project AND f.path = d.cand
  WHERE d.cand <> d.path""")
def q_py_dep_edges(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return D.dependency_edges(TB.python_files(docs).unionByName(TB.files_from_documents(docs)))


SQL_DIAGRAM_TREE = """
  SELECT project, 0 AS section, '' AS sort_path, 0 AS pos, 'graph TD' AS line FROM (SELECT DISTINCT project FROM ({paths}))
  UNION ALL
  SELECT project, 1, dir_path, 0, '    ' || translate(dir_path, '/.-', '___') || '("' || name || '/")'
  FROM ({dirs})
  UNION ALL
  SELECT project, 2, path, 0, '    ' || translate(path, '/.-', '___') || '[' || string_split(path, '/')[-1] || ']'
  FROM ({paths})
  UNION ALL
  SELECT project, 3, first_file, first_pos, '    ' || parent_id || ' --> ' || child_id FROM ({edges})"""


@register("diagram_lines", f"""
  {SQL_DIAGRAM_TREE.format(paths=SQL_DEP_FILES, dirs=SQL_DIRS.format(paths=SQL_DEP_FILES),
                           edges=SQL_TREE_EDGES.format(paths=SQL_DEP_FILES))}
  UNION ALL
  SELECT DISTINCT project, 4, '', x.pos, x.line
  FROM ({SQL_DEP_EDGES}), (SELECT 0 AS pos, '' AS line UNION ALL SELECT 1, '    %% dependency edges') x
  UNION ALL
  SELECT project, 5, arg_min(src_path, {{'k': string_split(src_path, '/'), 'o': dep_ord}}),
         CAST(arg_min(dep_ord, {{'k': string_split(src_path, '/'), 'o': dep_ord}}) AS INTEGER),
         '    ' || src_id || ' -.-> ' || dst_id
  FROM ({SQL_DEP_EDGES}) GROUP BY project, src_id, dst_id""")
def q_diagram_lines(spark, sf_dir):
    files = TB.dependency_files(_documents(spark, sf_dir))
    paths = files.select("project", "path")
    return TR.diagram_tree_lines(paths).unionByName(D.diagram_dep_lines(D.dependency_edges(files)))


# ------------------------------------------- 5. descriptions and the cache
from treesnap.operators import describe as DS  # noqa: E402
from treesnap.operators import registry as R  # noqa: E402
from treesnap.operators import search as SR  # noqa: E402
from treesnap.operators import usage as U  # noqa: E402
from treesnap.streaming import ingest as IG  # noqa: E402

def py_strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{PY_WS_CLASS}+', ''), '{PY_WS_CLASS}+\\z', '')"
def longest_sql(found: str, n: str) -> str:
    """The n longest strings of a list (bytes, ties to the earlier), in order."""
    ranked = f"list_sort(list_transform({found}, lambda s, i: {{'z': -strlen(s), 'i': i, 's': s}}))[1:{n}]"
    return f"list_transform(list_sort(list_transform({ranked}, lambda x: {{'i': x.i, 's': x.s}})), lambda x: x.s)"


def salient_sql(text: str, n: str) -> str:
    return f"array_to_string({longest_sql(f"regexp_extract_all({text}, '{SENTENCE_RE}', 0)", n)}, ' ')"


DESC_SQL = salient_sql("text", "sentences")


def _descriptions(spark, sf_dir):
    files, cache, work = _work(spark, sf_dir)
    generated = DS.stand_in_descriptions(changes.pending_work(files, work)).drop("error")
    return files, cache, changes.merge_descriptions(work, generated), generated


@register("file_descriptions", f"""
  WITH w AS ({SQL_WORK})
  SELECT project, path, sha256, status, COALESCE(cached_description, {DESC_SQL}) AS description FROM w""")
def q_file_descriptions(spark, sf_dir):
    _, _, merged, _ = _descriptions(spark, sf_dir)
    return merged.select("project", "path", "sha256", "status", "description")


@register("cache_upsert", f"""
  WITH w AS ({SQL_WORK}),
  new AS (SELECT project, path, sha256, {DESC_SQL} AS description FROM w WHERE status <> 'hit'),
  old AS ({SQL_CACHE})
  SELECT * FROM new
  UNION ALL
  SELECT old.* FROM old ANTI JOIN new ON old.project = new.project AND old.path = new.path""")
def q_cache_upsert(spark, sf_dir):
    _, cache, _, generated = _descriptions(spark, sf_dir)
    return R.upsert(cache, generated, ["project", "path"])


@register("file_listing", f"""
  WITH w AS ({SQL_WORK})
  SELECT project, path, path || ': ' || COALESCE(cached_description, {DESC_SQL}) AS line FROM w""")
def q_file_listing(spark, sf_dir):
    _, _, merged, _ = _descriptions(spark, sf_dir)
    return merged.select("project", "path", F.concat("path", F.lit(": "), "description").alias("line"))


# ------------------------------------------------------------- 6. registry
SQL_PUSHES = f"""
  SELECT doc_id, source || '-' || lang AS project,
         CASE WHEN doc_id < (SELECT count(*) FROM documents) / 2 THEN 0 ELSE 1 END AS batch,
         {DOC_PATH} AS path,
         {salient_sql('text', SENTENCES.format(n=N_LINES))} AS description,
         {salient_sql('text', '1')} AS readme,
         {longest_sql('string_split(text, chr(10))', '1')}[1] AS use_cases,
         CASE WHEN lang = 'en' THEN '' ELSE '  Write ' || lang || ' prose.  ' END AS conv_user,
         CASE WHEN lang = 'de' THEN '   ' ELSE 'Sources come from ' || source || '.' END AS conv_ai,
         source || '-' || lang || '/' || chr(10) || '└── doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS file_tree,
         'graph TD' || chr(10) || '    ' || translate({DOC_PATH}, '/.-', '___') || '[doc_'
           || CAST(doc_id AS VARCHAR) || '.txt]' AS architecture
  FROM documents"""
SQL_PUSH_CHUNKS = f"""
  SELECT doc_id, project, batch, 'file:' || path AS id, path, {py_strip_sql('description')} AS text
  FROM ({SQL_PUSHES}) WHERE {py_strip_sql('description')} <> ''
  UNION ALL
  SELECT doc_id, project, batch, 'file:README.md', 'README.md', {py_strip_sql('readme')}
  FROM ({SQL_PUSHES}) WHERE {py_strip_sql('readme')} <> ''"""
SQL_LATEST = "SELECT * FROM ({pushes}) QUALIFY row_number() OVER (PARTITION BY project{extra} ORDER BY doc_id DESC) = 1"
SQL_BATCH_REG = f"""
  SELECT l.project AS name, l.batch,
         CAST((SELECT count(*) FROM ({SQL_PUSH_CHUNKS}) c WHERE c.doc_id = l.doc_id) AS INTEGER) AS file_chunk_count
  FROM ({SQL_LATEST.format(pushes="SELECT * FROM (" + SQL_PUSHES + ") WHERE batch = {b}", extra="")}) l"""
SQL_REGISTRY = f"""
  WITH r0 AS ({SQL_BATCH_REG.replace('{b}', '0')}), r1 AS ({SQL_BATCH_REG.replace('{b}', '1')})
  SELECT r1.name, '{TB.BATCH_TIMES[1].replace(' ', 'T')}+00:00' AS last_indexed_at, r1.file_chunk_count,
         CASE WHEN r0.name IS NULL THEN 'created' ELSE 'updated' END AS action
  FROM r1 LEFT JOIN r0 ON r0.name = r1.name
  UNION ALL
  SELECT r0.name, '{TB.BATCH_TIMES[0].replace(' ', 'T')}+00:00', r0.file_chunk_count, 'kept'
  FROM r0 ANTI JOIN r1 ON r0.name = r1.name"""


_INGESTED: dict[tuple[str, str], tuple] = {}


def _ingested(spark, sf_dir):
    """Apply the two halves of the push log as batches 0 and 1 to a state
    folder under the checkpoint directory (state persisted between batches,
    as a running ingest does). Returns (batch 0, batch 1) results and the
    final state read back from storage. Reused within one application."""
    from treesnap.session import scratch_path
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INGESTED:
        pushes = TB.snapshot_pushes(_documents(spark, sf_dir))
        root = scratch_path(spark, "ingest-state")
        first = IG.ingest_to(spark, pushes.filter("batch = 0").select("value", "doc_id"), root, 0,
                             TB.BATCH_TIMES[0])
        second = IG.ingest_to(spark, pushes.filter("batch = 1").select("value", "doc_id"), root, 1,
                              TB.BATCH_TIMES[1])
        _INGESTED[key] = (first, second, IG.load_state(spark, root), root)
    return _INGESTED[key]


@register("overview_extract", f"""
  SELECT doc_id, project,
         NULLIF({py_strip_sql('use_cases')}, '') AS use_cases,
         NULLIF(array_to_string(list_filter([
             CASE WHEN {py_strip_sql('conv_user')} <> ''
                  THEN '[User-defined]' || chr(10) || {py_strip_sql('conv_user')} END,
             CASE WHEN {py_strip_sql('conv_ai')} <> ''
                  THEN '[AI-inferred]' || chr(10) || {py_strip_sql('conv_ai')} END],
           lambda x: x IS NOT NULL), chr(10) || chr(10)), '') AS conventions,
         NULLIF({py_strip_sql('architecture')}, '') AS diagram,
         NULLIF({py_strip_sql('file_tree')}, '') AS file_tree
  FROM ({SQL_PUSHES})""")
def q_overview_extract(spark, sf_dir):
    from treesnap.session import materialize
    from treesnap.sources import snapshots as S
    # the landed push log, as an ingest would read it (cut here so the accept
    # filter does not re-run the fixture's text work below the projection)
    pushes = materialize(TB.snapshot_pushes(_documents(spark, sf_dir)), "pushes")
    return R.overview_fields(S.accepted(S.parse(pushes)), extra=["doc_id"]).select(
        "doc_id", "project", "use_cases", "conventions", "diagram", "file_tree")


@register("registry_upsert", SQL_REGISTRY)
def q_registry_upsert(spark, sf_dir):
    _, second, state, _ = _ingested(spark, sf_dir)
    acted = second.results.select(F.col("project").alias("name"), "action")
    reg = state.projects.join(acted, "name", "left")
    return reg.select("name", R.iso("last_indexed_at").alias("last_indexed_at"),
                      "file_chunk_count", F.coalesce("action", F.lit("kept")).alias("action"))


@register("chunk_upsert", f"""
  SELECT project, id, path, text, CAST(doc_id AS BIGINT) AS push_doc
  FROM ({SQL_PUSH_CHUNKS}) QUALIFY row_number() OVER (PARTITION BY project, id ORDER BY doc_id DESC) = 1""")
def q_chunk_upsert(spark, sf_dir):
    _, _, state, _ = _ingested(spark, sf_dir)
    c = state.chunks
    # the push time carries the pushing doc_id
    secs = F.unix_timestamp("pushed") - F.unix_timestamp(F.lit(TB.PUSH_EPOCH))
    return c.select("project", "id", "path", "text", secs.cast("bigint").alias("push_doc"))


@register("list_projects", f"""
  WITH reg AS ({SQL_REGISTRY})
  SELECT name AS project, file_chunk_count AS chunks, last_indexed_at FROM reg ORDER BY name""")
def q_list_projects(spark, sf_dir):
    _, _, state, _ = _ingested(spark, sf_dir)
    return R.list_projects(state.projects)


SQL_OVERVIEWS = f"""
  SELECT project,
         NULLIF({py_strip_sql('use_cases')}, '') AS use_cases,
         NULLIF(array_to_string(list_filter([
             CASE WHEN {py_strip_sql('conv_user')} <> ''
                  THEN '[User-defined]' || chr(10) || {py_strip_sql('conv_user')} END,
             CASE WHEN {py_strip_sql('conv_ai')} <> ''
                  THEN '[AI-inferred]' || chr(10) || {py_strip_sql('conv_ai')} END],
           lambda x: x IS NOT NULL), chr(10) || chr(10)), '') AS conventions,
         NULLIF({py_strip_sql('architecture')}, '') AS diagram,
         NULLIF({py_strip_sql('file_tree')}, '') AS file_tree
  FROM ({SQL_LATEST.format(pushes=SQL_PUSHES, extra='')})"""
LOOKUP_FIELDS = ("use_cases", "conventions", "diagram", "file_tree", "summary")


def _overview_requests(spark, sf_dir):
    b = TB.table(spark, sf_dir, "benchmark")
    fields = F.array(*[F.lit(f) for f in LOOKUP_FIELDS])
    return b.select("item_id", F.concat(F.lit("src"), (F.col("item_id") % 24).cast("string"),
                                        F.lit("-en")).alias("project"),
                    F.element_at(fields, (F.col("item_id") % len(LOOKUP_FIELDS) + 1).cast("int")).alias("field"))


@register("overview_lookup", f"""
  WITH req AS (
    SELECT item_id, 'src' || CAST(item_id % 24 AS VARCHAR) || '-en' AS project,
           {list(LOOKUP_FIELDS)}[item_id % {len(LOOKUP_FIELDS)} + 1] AS field FROM benchmark),
  ov AS ({SQL_OVERVIEWS}),
  j AS (SELECT req.item_id, req.project, req.field, ov.project IS NOT NULL AS known,
          CASE req.field WHEN 'use_cases' THEN ov.use_cases WHEN 'conventions' THEN ov.conventions
                         WHEN 'diagram' THEN ov.diagram WHEN 'file_tree' THEN ov.file_tree END AS v
        FROM req LEFT JOIN ov ON ov.project = req.project)
  SELECT item_id, project, field,
         CASE WHEN known AND v IS NOT NULL AND v <> '' THEN v END AS value,
         CASE WHEN NOT known THEN 'Unknown project ''' || project || ''''
              WHEN v IS NULL OR v = '' THEN 'No ' || field || ' found for project ''' || project || '''' END AS error
  FROM j""")
def q_overview_lookup(spark, sf_dir):
    _, _, state, _ = _ingested(spark, sf_dir)
    req = _overview_requests(spark, sf_dir)
    return R.overview_lookup(req.select("project", "field", "item_id"), state.overviews)


SQL_GRAMS = "list_distinct(list_transform(range(1, length({x}) + 2), lambda i: substring('  ' || lower({x}) || ' ', CAST(i AS INTEGER), 3)))"


@register("nearest_projects", f"""
  WITH a AS (SELECT DISTINCT 'src' || CAST(item_id % 24 AS VARCHAR) || '-en' AS name FROM benchmark
             UNION SELECT DISTINCT lang || '-src' || CAST(doc_id % 31 AS VARCHAR) FROM documents),
  k AS (SELECT DISTINCT source || '-' || lang AS near FROM documents),
  u AS (SELECT name, unnest({SQL_GRAMS.format(x='name')}) AS run FROM a ANTI JOIN k ON k.near = a.name),
  r AS (SELECT near, unnest({SQL_GRAMS.format(x='near')}) AS run FROM k),
  p AS (SELECT name, near, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, levenshtein(lower(name), lower(near)), near) AS place
        FROM u JOIN r USING (run) GROUP BY name, near),
  n AS (SELECT name, string_agg(near, ', ' ORDER BY place) AS nearest FROM p WHERE place <= 3 GROUP BY name)
  SELECT a.name AS project, CASE WHEN k.near IS NULL THEN 'Unknown project ''' || a.name || '''' || coalesce('. Nearest: ' || nearest, '') END AS error
  FROM a LEFT JOIN k ON k.near = a.name LEFT JOIN n ON n.name = a.name""")
def q_nearest_projects(spark, sf_dir):
    """Look-ups under known and unknown names: the error tells the nearest
    registered names."""
    _, _, state, _ = _ingested(spark, sf_dir)
    req = _overview_requests(spark, sf_dir).select("project").unionByName(_documents(spark, sf_dir).select(
        F.concat("lang", F.lit("-src"), (F.col("doc_id") % 31).cast("string")).alias("project"))).distinct().withColumn("field", F.lit("file_tree"))
    return R.overview_lookup(req, state.overviews, state.projects).select("project", "error")


@register("file_lookup", f"""
  WITH req AS (SELECT DISTINCT 'src' || CAST(doc_id % 20 AS VARCHAR) || '/en/doc_' || CAST(doc_id AS VARCHAR)
                      || '.txt' AS path FROM labels),
  ch AS ({SQL_PUSH_CHUNKS})
  SELECT req.path, ch.project, ch.text,
         CASE WHEN ch.project IS NULL THEN 'File not found in index: ' || req.path END AS error
  FROM req LEFT JOIN ch ON ch.id = 'file:' || req.path""")
def q_file_lookup(spark, sf_dir):
    _, _, state, _ = _ingested(spark, sf_dir)
    labels = TB.table(spark, sf_dir, "labels")
    req = labels.select(F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string"), F.lit("/en/doc_"),
                                 F.col("doc_id").cast("string"), F.lit(".txt")).alias("path")).distinct()
    return R.file_lookup(req, state.chunks)


SQL_REGISTERED = f"""
  SELECT name AS project FROM ({SQL_REGISTRY})
  UNION ALL SELECT DISTINCT 'empty ' || lang FROM documents"""
SQL_SLUG = ("(CASE WHEN regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g') = '' THEN 'default' ELSE "
            "regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') END)")


def _registered(spark, sf_dir, state):
    """The ingested registry and one project without chunks per language."""
    empty = _documents(spark, sf_dir).select(F.concat(F.lit("empty "), "lang").alias("name")).distinct()
    return state.projects.select("name").unionByName(empty)


@register("collections", f"""
  WITH ch AS (SELECT * FROM ({SQL_PUSH_CHUNKS})
              QUALIFY row_number() OVER (PARTITION BY project, id ORDER BY doc_id DESC) = 1),
  g AS (SELECT project, count(*) AS chunks FROM ch GROUP BY project)
  SELECT r.project, {SQL_SLUG.format(x='r.project')} AS collection, CAST(coalesce(chunks, 0) AS BIGINT) AS chunks,
         coalesce(chunks, 0) = 0 AS is_empty FROM ({SQL_REGISTERED}) r LEFT JOIN g USING (project)""")
def q_collections(spark, sf_dir):
    _, _, state, _ = _ingested(spark, sf_dir)
    return R.collections(_registered(spark, sf_dir, state), state.chunks)


@register("collection_names", f"""
  SELECT DISTINCT 'files_' || {SQL_SLUG.format(x='project')} AS collection FROM ({SQL_REGISTERED})
  WHERE starts_with('files_' || {SQL_SLUG.format(x='project')}, 'files_src1')""")
def q_collection_names(spark, sf_dir):
    _, _, state, _ = _ingested(spark, sf_dir)
    return R.collection_names(_registered(spark, sf_dir, state), "files_", "files_src1")


# ---------------------------------------------------------------- 7. search
SQL_KNN = """
  WITH q AS (SELECT b.item_id AS query_id, e.embedding AS qv FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
  c AS (SELECT CAST(label AS VARCHAR) AS project, vec_id, 'file:vec_' || CAST(vec_id AS VARCHAR) AS id, embedding
        FROM embeddings),
  d AS (SELECT q.query_id, c.project, c.vec_id, c.id,
               round(list_sum(list_transform(list_zip(c.embedding, q.qv),
                                       lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ^ 2)), 9) AS dist
        FROM q, c),
  pp AS (SELECT *, row_number() OVER (PARTITION BY query_id, project ORDER BY dist, id) AS prank FROM d
         QUALIFY prank <= 5)"""


def _knn_inputs(spark, sf_dir):
    emb = TB.table(spark, sf_dir, "embeddings")
    bench = TB.table(spark, sf_dir, "benchmark")
    chunks = emb.select(F.col("label").cast("string").alias("project"),
                        F.concat(F.lit("file:vec_"), F.col("vec_id").cast("string")).alias("id"),
                        "vec_id", "embedding")
    queries = bench.join(emb, bench.item_id == emb.vec_id, "inner").select(
        F.col("item_id").alias("query_id"), "embedding")
    return chunks, queries


@register("knn_per_project", SQL_KNN + """
  SELECT query_id, project, CAST(prank AS INTEGER) AS rank, vec_id, round(1 - dist, 4) AS score FROM pp""")
def q_knn_per_project(spark, sf_dir):
    chunks, queries = _knn_inputs(spark, sf_dir)
    pp = SR.per_project(SR.candidates(chunks, queries, 5), 5)
    return pp.select("query_id", "project", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@register("knn_global", SQL_KNN + """
  SELECT query_id, CAST(rank AS INTEGER) AS rank, project, vec_id, score FROM (
    SELECT *, round(1 - dist, 4) AS score,
           row_number() OVER (PARTITION BY query_id ORDER BY round(1 - dist, 4) DESC, project, dist, id) AS rank
    FROM pp) WHERE rank <= 5""")
def q_knn_global(spark, sf_dir):
    chunks, queries = _knn_inputs(spark, sf_dir)
    g = SR.search(chunks, queries, None, k=5)
    return g.select("query_id", F.col("rank").cast("int").alias("rank"), "project", "vec_id", "score")


SQL_TOP5 = """
  SELECT query_id, CAST(rank AS INTEGER) AS rank, project, {cols}, score FROM (
    SELECT *, round(1 - dist, 4) AS score,
           row_number() OVER (PARTITION BY query_id ORDER BY round(1 - dist, 4) DESC, project, dist, id) AS rank
    FROM ({scored})) WHERE rank <= 5"""
DOT_SQL = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


def cosine_sql(a: str, b: str) -> str:
    dot = lambda x, y: DOT_SQL.format(a=x, b=y)
    return (f"round(1 - CASE WHEN {dot(a, a)} > 0 AND {dot(b, b)} > 0 "
            f"THEN {dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})) ELSE 0 END, 9)")


# every 50th vector is the zero vector; project 9 is not registered
SQL_SPARSE = """
  WITH e AS (SELECT vec_id, CAST(label AS VARCHAR) AS project, 'file:vec_' || CAST(vec_id AS VARCHAR) AS id,
                    CASE WHEN vec_id % 50 = 0 THEN list_transform(embedding, lambda x: CAST(0 AS FLOAT)) ELSE embedding END AS v
             FROM embeddings)
  SELECT b.item_id AS query_id, c.project, c.id, c.vec_id, {dist} AS dist
  FROM benchmark b JOIN e q ON q.vec_id = b.item_id, e c WHERE c.project <> '9'"""


def _sparse_search(spark, sf_dir, metric):
    chunks, queries = _knn_inputs(spark, sf_dir)
    zeroed = lambda df, key: df.withColumn("embedding", F.when(
        F.col(key) % 50 == 0, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("embedding")))
    registry = chunks.select(F.col("project").alias("name")).distinct().where("name != '9'")
    g = SR.search(zeroed(chunks, "vec_id"), zeroed(queries, "query_id"), registry, k=5, metric=metric)
    return g.select("query_id", F.col("rank").cast("int").alias("rank"), "project", "vec_id", "score")


@register("knn_cosine", SQL_TOP5.format(cols="vec_id", scored=SQL_SPARSE.format(dist=cosine_sql("c.v", "q.v"))))
def q_knn_cosine(spark, sf_dir):
    """Cosine search with zero vectors and an unregistered project."""
    return _sparse_search(spark, sf_dir, "cosine")


@register("knn_ip", SQL_TOP5.format(cols="vec_id", scored=SQL_SPARSE.format(dist=f"round(1 - {DOT_SQL.format(a='c.v', b='q.v')}, 9)")))
def q_knn_ip(spark, sf_dir):
    """Inner-product search with zero vectors and an unregistered project."""
    return _sparse_search(spark, sf_dir, "ip")


def embedding_sql(rows: str, keys: str) -> str:
    """(keys, v) from rows of (keys, text): the stand-in embedding."""
    return f"""
  SELECT {keys}, list_transform(c, lambda x: CAST(CASE WHEN n > 0 THEN x / n ELSE 0 END AS FLOAT)) AS v FROM (
    SELECT *, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS n FROM (
      SELECT *, list_transform(range({DS.EMBED_DIM}), lambda d: CAST(len(list_filter(b, lambda x: x = d)) AS DOUBLE)) AS c FROM (
        SELECT *, list_transform(regexp_extract_all(lower(text), '{DS.TOKEN_PATTERN}'),
                                 lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {DS.EMBED_DIM}) AS b FROM ({rows}))))"""


SQL_TEXT_SCORED = f"""
  SELECT q.query_id, c.project, c.id, c.path, {cosine_sql('c.v', 'q.v')} AS dist
  FROM ({embedding_sql('SELECT item_id AS query_id, text FROM benchmark', 'query_id')}) q,
       ({embedding_sql(f"SELECT * FROM ({SQL_PUSH_CHUNKS}) QUALIFY row_number() OVER (PARTITION BY project, id ORDER BY doc_id DESC) = 1",
                       'project, id, path')}) c"""


@register("text_search", SQL_TOP5.format(cols="id", scored=SQL_TEXT_SCORED))
def q_text_search(spark, sf_dir):
    """Benchmark texts as queries against the ingested description chunks of
    the registered projects, both embedded with the stand-in embedding."""
    _, _, state, _ = _ingested(spark, sf_dir)
    bench = TB.table(spark, sf_dir, "benchmark")
    queries = DS.with_hashed_embedding(bench.select(F.col("item_id").alias("query_id"), "text")).drop("text")
    chunks = state.chunks.select("project", "id", "path", "embedding")
    g = SR.search(chunks, queries, state.projects, k=5, metric="cosine")
    return g.select("query_id", F.col("rank").cast("int").alias("rank"), "project", "id", "score")


# ----------------------------------------------------------------- 8. usage


@register("answer_usage", f"""
  WITH w AS ({SQL_WORK})
  SELECT project, CAST(sum(length({PROMPT_SQL})) AS BIGINT) AS input_tokens, CAST(3 * count(*) AS BIGINT) AS output_tokens,
         CAST(count(*) AS BIGINT) AS calls, CAST(sum(length({PROMPT_SQL})) + 3 * count(*) AS BIGINT) AS total_tokens
  FROM w WHERE status <> 'hit' GROUP BY project""")
def q_answer_usage(spark, sf_dir):
    """Every pending file described by a model that tells its tokens (the
    prompt's characters, and 3), in two runs over the same answer store, of which
    the second finds what the first has answered: the log, per project."""
    from treesnap.session import scratch_path
    from treesnap.sources.answers import AnswerStore
    files, _, work = _work(spark, sf_dir)
    store = AnswerStore(spark, scratch_path(spark, "answers"))
    rows = changes.pending_work(files, work).select("project", "path", "sha256", "prompt")
    model = lambda prompts, max_tokens: [("An answer.", len(p), 3) for p in prompts]
    store.ask(rows.where("path < 'src5'"), model, 512, 8)
    store.ask(rows, model, 512, 8)
    return store.usage(["project"])


@register("token_usage", """
  SELECT conv_id,
         CAST(sum(CASE WHEN role <> 'assistant' THEN (strlen(text) + 3) // 4 ELSE 0 END) AS BIGINT) AS input_tokens,
         CAST(sum(CASE WHEN role = 'assistant' THEN (strlen(text) + 3) // 4 ELSE 0 END) AS BIGINT) AS output_tokens,
         CAST(count(*) FILTER (WHERE role = 'assistant') AS BIGINT) AS calls,
         CAST(sum((strlen(text) + 3) // 4) AS BIGINT) AS total_tokens
  FROM conversations GROUP BY conv_id""")
def q_token_usage(spark, sf_dir):
    conv = TB.table(spark, sf_dir, "conversations")
    return U.usage(U.call_log_from_turns(conv), ["conv_id"])


# ------------------------------------------------------- 9. build + stream
from treesnap.plans import build as BLD  # noqa: E402

GENERATED_AT = "2026-01-12T00:00:00+00:00"
SYNTH_INSTRUCTIONS = "Answer questions about the corpus."


def _build(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    cache = TB.previous_cache(docs)
    settings = BLD.BuildSettings(generated_at=GENERATED_AT, instructions=SYNTH_INSTRUCTIONS)
    return BLD.build(TB.files_from_documents(docs), cache, TB.previous_synthesis(cache), settings)


@register("synthesis_merge", f"""
  WITH w AS ({SQL_WORK}),
  cache AS ({SQL_CACHE}),
  prev AS (SELECT project, 'graph LR' || chr(10) || '    user --> ' || project AS use_cases,
                  '- ' || CAST(count(*) AS VARCHAR) || ' files described' AS conventions_ai
           FROM cache GROUP BY project),
  counts AS (SELECT project, count(*) AS total_files, count(*) FILTER (WHERE status <> 'hit') AS miss_files
             FROM w GROUP BY project),
  gate AS (SELECT counts.project, total_files FROM counts LEFT JOIN prev ON prev.project = counts.project
           WHERE prev.project IS NULL OR miss_files / total_files >= 0.2),
  tops AS (SELECT project, count(*) AS n_top, arg_max(top, {{'c': c, 't': top}}) AS main_top FROM (
             SELECT project, string_split(path, '/')[1] AS top, count(*) AS c FROM w
             WHERE len(string_split(path, '/')) > 1 GROUP BY 1, 2) GROUP BY project),
  exts AS (SELECT project, arg_max(ext, {{'c': c, 'e': ext}}) AS main_ext FROM (
             SELECT project, lower(regexp_extract(string_split(path, '/')[-1], '^.+\\.([^./]+)$', 1)) AS ext,
                    count(*) AS c FROM w GROUP BY 1, 2) GROUP BY project),
  regen AS (
    SELECT gate.project,
           'graph LR' || chr(10) || '    user((User)) --> ' || gate.project || chr(10) || '    ' || gate.project
             || ' --> ' || COALESCE(main_top, 'root') AS use_cases,
           '- ' || CAST(total_files AS VARCHAR) || ' files across ' || CAST(COALESCE(n_top, 0) AS VARCHAR)
             || ' top-level directories' || chr(10) || '- most files are .' || COALESCE(NULLIF(main_ext, ''), '(none)')
             AS conventions_ai
    FROM gate LEFT JOIN tops ON tops.project = gate.project LEFT JOIN exts ON exts.project = gate.project)
  SELECT project, use_cases, conventions_ai, TRUE AS regenerated FROM regen
  UNION ALL
  SELECT prev.project, prev.use_cases, prev.conventions_ai, FALSE FROM prev ANTI JOIN regen USING (project)""")
def q_synthesis_merge(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    files, cache, work = _work(spark, sf_dir)
    gate = changes.change_gate(changes.miss_counts(work), TB.previous_synthesis(cache))
    regen = DS.stand_in_synthesis(gate, work)
    merged = DS.merge_synthesis(TB.previous_synthesis(cache), regen)
    flag = regen.select("project", F.lit(True).alias("regenerated"))
    return merged.join(flag, "project", "left").select(
        "project", "use_cases", "conventions_ai", F.coalesce("regenerated", F.lit(False)).alias("regenerated"))


def _sql_snapshot() -> str:
    """Document lines of the build over ``documents`` (no dependency section:
    .txt files have no parser)."""
    j = lambda x: f"CAST(to_json({x}) AS VARCHAR)"
    fixed = [
        (0, "'{'"), (1, "'  \"metadata\": {'"), (2, f"'    \"name\": ' || {j('project')} || ','"),
        (3, f"'    \"generated_at\": \"{GENERATED_AT}\",'"), (4, "'    \"file_count\": ' || CAST(n AS VARCHAR)"),
        (5, "'  },'"), (6, f"'  \"instructions\": ' || {j(repr(SYNTH_INSTRUCTIONS))} || ','"),
        (7, f"'  \"use_cases\": ' || {j(py_strip_sql('COALESCE(use_cases, \'\')'))} || ','"),
        (8, "'  \"conventions\": {'"), (9, "'    \"user\": \"\",'"),
        (10, f"'    \"ai\": ' || {j(py_strip_sql('COALESCE(conventions_ai, \'\')'))}"),
        (11, "'  },'"), (12, "'  \"file_tree\": ['"), (14, "'  ],'"), (15, "'  \"architecture\": ['"),
        (17, "'  ],'"), (18, "'  \"files\": {'"), (20, "'  }'"), (21, "'}'")]
    items = ", ".join(f"{{'sec': {sec}, 'line': {expr}}}" for sec, expr in fixed)
    diagram = SQL_DIAGRAM_TREE.format(paths=SQL_PATHS, dirs=SQL_DIRS.format(paths=SQL_PATHS),
                                      edges=SQL_TREE_EDGES.format(paths=SQL_PATHS))
    return f"""
  WITH syn AS ({ORACLE['synthesis_merge']}),
  fd AS ({ORACLE['file_descriptions']}),
  meta AS (SELECT c.project, c.n, syn.use_cases, syn.conventions_ai
           FROM (SELECT project, count(*) AS n FROM fd GROUP BY project) c LEFT JOIN syn ON syn.project = c.project),
  fixed AS (SELECT project, l.sec AS sec, 0 AS k1, '' AS k2, 0 AS k3, l.line AS line
            FROM (SELECT project, unnest([{items}]) AS l FROM meta)),
  tl AS ({ORACLE['tree_lines']}),
  tree AS (SELECT project, 13 AS sec, 0 AS k1, node_path AS k2, 0 AS k3,
                  '    ' || {j('line')} || CASE WHEN row_number() OVER (PARTITION BY project ORDER BY
                      CASE WHEN node_path = '' THEN []::VARCHAR[] ELSE string_split(node_path, '/') END DESC) = 1
                    THEN '' ELSE ',' END AS line FROM tl),
  dl AS ({diagram}),
  arch AS (SELECT project, 16 AS sec, section AS k1, sort_path AS k2, pos AS k3,
                  '    ' || {j('line')} || CASE WHEN row_number() OVER (PARTITION BY project ORDER BY section DESC,
                      CASE WHEN section = 1 THEN [sort_path] ELSE string_split(sort_path, '/') END DESC, pos DESC) = 1
                    THEN '' ELSE ',' END AS line FROM dl),
  files AS (SELECT project, 19 AS sec, 0 AS k1, path AS k2, 0 AS k3,
                   '    ' || {j('path')} || ': ' || {j("COALESCE(description, '')")}
                   || CASE WHEN row_number() OVER (PARTITION BY project ORDER BY path DESC) = 1 THEN '' ELSE ',' END
                   AS line FROM fd)
  SELECT project, CAST(sec AS INTEGER) AS sec, CAST(k1 AS INTEGER) AS k1, k2, CAST(k3 AS INTEGER) AS k3, line
  FROM (SELECT * FROM fixed UNION ALL SELECT * FROM tree UNION ALL SELECT * FROM arch UNION ALL SELECT * FROM files)"""


@register("snapshot_json", _sql_snapshot())
def q_snapshot_json(spark, sf_dir):
    """Every project's snapshot document as ordered JSON lines with their
    sort keys (section, then k1/k2/k3)."""
    res = _build(spark, sf_dir)
    return res.document_lines.select("project", "sec", F.col("ord.k1").alias("k1"),
                                     F.array_join("ord.k2", "/").alias("k2"), F.col("ord.k3").alias("k3"), "line")


@register("stream_ingest", SQL_REGISTRY)
def q_stream_ingest(spark, sf_dir):
    """The push log landed as JSON Lines in two drops, each consumed by a
    Structured Streaming availableNow run (foreachBatch ingest). Result: the
    registry after both micro-batches, as in ``registry_upsert``."""
    from treesnap.session import scratch_path
    pushes = TB.snapshot_pushes(_documents(spark, sf_dir))
    landing, root, ckpt = (scratch_path(spark, n) for n in ("landing", "stream-state", "stream-ckpt"))
    clock = lambda batch_id: F.lit(TB.BATCH_TIMES[min(batch_id, 1)]).cast("timestamp")
    for b in (0, 1):
        pushes.filter(F.col("batch") == b).select("value").write.mode("append").text(landing)
        q = IG.start_stream(spark, landing, root, ckpt, clock=clock, available_now=True)
        q.awaitTermination()
    return _registry_after(spark, root)


def _registry_after(spark, root):
    """The registry with the action of the last batch, from the two states."""
    last = IG.batches(spark, root)[-1]
    state, before = IG.load_state(spark, root), IG.load_state(spark, root, before=last)
    known = before.projects.select("name", F.lit(True).alias("_known"))
    now = F.col("last_indexed_at") == F.lit(TB.BATCH_TIMES[1]).cast("timestamp")
    action = F.when(~now, "kept").when(F.col("_known"), "updated").otherwise("created")
    return state.projects.join(known, "name", "left").select(
        "name", R.iso("last_indexed_at").alias("last_indexed_at"), "file_chunk_count", action.alias("action"))


@register("stream_replay", f"""
  WITH reg AS ({SQL_REGISTRY}),
  ch AS (SELECT project, count(*) AS n FROM (
           SELECT * FROM ({SQL_PUSH_CHUNKS}) QUALIFY row_number() OVER (PARTITION BY project, id ORDER BY doc_id DESC) = 1)
         GROUP BY project)
  SELECT name, last_indexed_at, file_chunk_count, action, CAST(coalesce(n, 0) AS BIGINT) AS chunks
  FROM reg LEFT JOIN ch ON ch.project = reg.name""")
def q_stream_replay(spark, sf_dir):
    """The second batch of the push log is applied three times, the second
    time without its marker (a batch that failed half way)."""
    from treesnap.session import scratch_path
    pushes = TB.snapshot_pushes(_documents(spark, sf_dir))
    root = scratch_path(spark, "replay-state")
    batch = lambda b: pushes.filter(F.col("batch") == b).select("value")
    IG.ingest_to(spark, batch(0), root, 0, TB.BATCH_TIMES[0])
    half = IG.ingest_batch(IG.load_state(spark, root, before=1), batch(1), TB.BATCH_TIMES[1])
    half.changed.chunks.withColumn("v", F.lit(1).cast("long")).write.parquet(f"{root}/chunks/v=1")
    for _ in range(2):
        IG.ingest_to(spark, batch(1), root, 1, TB.BATCH_TIMES[1])
    chunks = IG.load_state(spark, root).chunks.groupBy(F.col("project").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return _registry_after(spark, root).join(chunks, "name", "left").select(
        "name", "last_indexed_at", "file_chunk_count", "action", F.coalesce("n", F.lit(0)).cast("bigint").alias("chunks"))


SQL_SPOILED = """
  SELECT doc_id, CASE WHEN doc_id < (SELECT count(*) FROM documents) / 2 THEN 0 ELSE 1 END AS batch,
         CASE doc_id % 4 WHEN 0 THEN '{msg}' WHEN 1 THEN '{msg}' ELSE 'Missing metadata.name' END AS message
  FROM documents WHERE doc_id % 4 < 3""".replace("{msg}", "Invalid JSON body")


def _spoiled():
    """A push spoiled by a rule: cut short, wrapped in an array, nameless, or
    (the last quarter) sound."""
    value, k = F.col("value"), F.col("doc_id") % 4
    return (F.when(k == 0, F.expr("substr(value, 1, length(value) - 1)")).when(k == 1, F.concat(F.lit("["), value, F.lit("]")))
            .when(k == 2, F.regexp_replace(value, '^\\{"metadata":\\{"name":"[^"]*",', '{"metadata":{')).otherwise(value))


def _pushed_doc():
    """The doc_id of a push, from the paths in its text."""
    return F.regexp_extract("value", r'/doc_(\d+)\.txt', 1).cast("bigint").alias("doc_id")


@register("stream_rejects", f"""
  SELECT doc_id, CAST(batch AS BIGINT) AS batch, message FROM ({SQL_SPOILED})""")
def q_stream_rejects(spark, sf_dir):
    """Spoiled pushes streamed in two drops, the second batch then applied
    once more: every reject stands in the stream's log once, with its text."""
    from treesnap.session import scratch_path
    pushes = TB.snapshot_pushes(_documents(spark, sf_dir)).select("batch", _spoiled().alias("value"))
    landing, root, ckpt = (scratch_path(spark, n) for n in ("landing", "reject-state", "reject-ckpt"))
    for b in (0, 1):
        pushes.filter(F.col("batch") == b).select("value").write.mode("append").text(landing)
        IG.start_stream(spark, landing, root, ckpt).awaitTermination()
    IG.ingest_to(spark, pushes.filter("batch = 1").select("value"), root, 1, TB.BATCH_TIMES[1])
    return IG.load_rejects(spark, root).select(_pushed_doc(), "batch", "message")


STALE_BATCHES = 3
SQL_ARRIVALS = f"""
  SELECT doc_id, source || '-' || lang AS project, doc_id * 7919 % n AS turn,
         CAST(floor({STALE_BATCHES} * (doc_id * 7919 % n) / n) AS BIGINT) AS batch
  FROM documents, (SELECT count(*) AS n FROM documents)"""


@register("stale_pushes", f"""
  SELECT doc_id, batch, 'Stale push: ' || strftime(TIMESTAMP '{TB.PUSH_EPOCH}' + to_seconds(doc_id), '%Y-%m-%dT%H:%M:%S+00:00')
           || ' is older than ' || strftime(TIMESTAMP '{TB.PUSH_EPOCH}' + to_seconds(newest), '%Y-%m-%dT%H:%M:%S+00:00') AS message
  FROM (SELECT *, max(doc_id) OVER (PARTITION BY project ORDER BY turn, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest
        FROM ({SQL_ARRIVALS})) WHERE newest > doc_id""")
def q_stale_pushes(spark, sf_dir):
    """The push log in a shuffled order of arrival and three batches: a push
    that is older than an earlier one of its project is rejected."""
    from treesnap.session import materialize, scratch_path
    docs = _documents(spark, sf_dir)
    n = docs.select(F.count(F.lit(1))).scalar()
    turn = F.col("doc_id") * 7919 % n
    pushes = materialize(TB.snapshot_pushes(docs).select("doc_id", "value", turn.alias("turn"), F.floor(STALE_BATCHES * turn / n).alias("drop")), "pushes")
    root = scratch_path(spark, "stale-state")
    for b in range(STALE_BATCHES):
        IG.ingest_to(spark, pushes.where(F.col("drop") == b).select("value", "doc_id", "turn"), root, b, TB.BATCH_TIMES[0], stale="reject", arrival=["turn", "doc_id"])
    return IG.load_rejects(spark, root).select(_pushed_doc(), "batch", "message")


@register("rejected_documents", f"""
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{{msg}}' WHEN 1 THEN '{{msg}}' ELSE 'Missing metadata.name' END AS error
  FROM documents WHERE doc_id % 4 < 3""".replace("{msg}", "Invalid JSON body"))
def q_rejected_documents(spark, sf_dir):
    """Every push spoiled by a rule: cut short, wrapped in an array, nameless,
    or (the last quarter) sound. Rejects are reported with their reason."""
    from treesnap.session import materialize
    from treesnap.sources import snapshots as S
    pushes = materialize(TB.snapshot_pushes(_documents(spark, sf_dir)).select("doc_id", _spoiled().alias("value")), "pushes")
    return S.rejected(S.parse(pushes)).select("doc_id", "error")


# ------------------------------------------------ 10. filters and counters
FILTER_PROJECTS = ("1", "3", "7")


@register("knn_filtered", SQL_KNN.replace(
    "FROM embeddings),", f"FROM embeddings WHERE CAST(label AS VARCHAR) IN {FILTER_PROJECTS}),") + """
  SELECT query_id, CAST(rank AS INTEGER) AS rank, project, vec_id, score FROM (
    SELECT *, round(1 - dist, 4) AS score,
           row_number() OVER (PARTITION BY query_id ORDER BY round(1 - dist, 4) DESC, project, dist, id) AS rank
    FROM pp) WHERE rank <= 5""")
def q_knn_filtered(spark, sf_dir):
    """Search restricted to a list of projects (semi-join with the list)."""
    chunks, queries = _knn_inputs(spark, sf_dir)
    wanted = spark.createDataFrame([(p,) for p in FILTER_PROJECTS], "name string")
    g = SR.search(chunks, queries, None, k=5, projects=wanted)
    return g.select("query_id", F.col("rank").cast("int").alias("rank"), "project", "vec_id", "score")


@register("cache_size", f"""
  WITH w AS ({SQL_WORK}),
  new AS (SELECT project, path FROM w WHERE status <> 'hit'),
  old AS ({SQL_CACHE}),
  c AS (SELECT project, path FROM new UNION ALL
        SELECT old.project, old.path FROM old ANTI JOIN new ON old.project = new.project AND old.path = new.path)
  SELECT project, CAST(count(*) AS BIGINT) AS entries FROM c GROUP BY project""")
def q_cache_size(spark, sf_dir):
    _, cache, _, generated = _descriptions(spark, sf_dir)
    c = R.upsert(cache, generated, ["project", "path"])
    return c.groupBy("project").agg(F.count(F.lit(1)).cast("bigint").alias("entries"))


@register("ingest_results", f"""
  WITH r0 AS ({SQL_BATCH_REG.replace('{b}', '0')}), r1 AS ({SQL_BATCH_REG.replace('{b}', '1')}),
  ov AS ({SQL_OVERVIEWS.replace(SQL_LATEST.format(pushes=SQL_PUSHES, extra=''),
                                SQL_LATEST.format(pushes="SELECT * FROM (" + SQL_PUSHES + ") WHERE batch = 1",
                                                  extra=''))})
  SELECT 'ok' AS status, r1.name AS project, r1.file_chunk_count AS chunks,
         CASE WHEN r0.name IS NULL THEN 'created' ELSE 'updated' END AS action,
         '{TB.BATCH_TIMES[1].replace(' ', 'T')}+00:00' AS indexed_at,
         array_to_string(list_filter(['use_cases', 'conventions', 'diagram', 'file_tree'],
           lambda f: CASE f WHEN 'use_cases' THEN ov.use_cases IS NOT NULL
                            WHEN 'conventions' THEN ov.conventions IS NOT NULL
                            WHEN 'diagram' THEN ov.diagram IS NOT NULL
                            ELSE ov.file_tree IS NOT NULL END), ',') AS overview_fields
  FROM r1 LEFT JOIN r0 ON r0.name = r1.name JOIN ov ON ov.project = r1.name""")
def q_ingest_results(spark, sf_dir):
    """Per-project result rows of the second ingest batch (action, chunk
    count, timestamp and the overview fields present)."""
    _, second, _, _ = _ingested(spark, sf_dir)
    return second.results.select("status", "project", "chunks", "action", "indexed_at",
                                 F.array_join("overview_fields", ",").alias("overview_fields"))



# ------------------------------------------------------- 11. tree source
@register("tree_scan", ORACLE["file_meta"])
def q_tree_scan(spark, sf_dir):
    """The documents landed as real files (one folder per project) and read
    back through the tree data source, then hashed and measured."""
    from treesnap.session import scratch_path
    from treesnap.sources.files import read_tree, write_tree
    root = scratch_path(spark, "tree")
    local = root.removeprefix("file://").removeprefix("file:")
    write_tree(TB.files_from_documents(_documents(spark, sf_dir)), local)
    return changes.file_meta(read_tree(spark, local, multi=True, tasks=16))


@register("tree_meta", ORACLE["file_meta"] + " WHERE source < 'src2' AND starts_with(" + DOC_PATH + ", 'src1')")
def q_tree_meta(spark, sf_dir):
    """The documents landed as files and hashed where they lie; the filters on
    project and path reach the source."""
    from treesnap.session import scratch_path
    from treesnap.sources.files import tree_meta, write_tree
    root = scratch_path(spark, "tree")
    local = root.removeprefix("file://").removeprefix("file:")
    docs = _documents(spark, sf_dir)
    write_tree(TB.files_from_documents(docs), local)
    names = [r[0] for r in docs.select("source").distinct().where("source < 'src2'").collect()]   # the projects asked for
    return tree_meta(spark, local, multi=True).where(F.col("project").isin(names) & F.col("path").startswith("src1"))


# ------------------------------------------------- 12. synthesis prompts
from treesnap.operators import synthesis as SY  # noqa: E402



SQL_SYNTH_VALUES = {"project": "project", "part": "CAST(part AS VARCHAR)", "parts": "CAST(parts AS VARCHAR)", "material": "material",
                    "instructions": f"'{SYNTH_INSTRUCTIONS}'"}


@register("synthesis_prompts", f"""
  WITH w AS ({SQL_WORK}),
  prev AS (SELECT DISTINCT project FROM ({SQL_CACHE})),
  counts AS (SELECT project, count(*) AS total_files, count(*) FILTER (WHERE status <> 'hit') AS miss_files
             FROM w GROUP BY project),
  regen AS (SELECT counts.project FROM counts LEFT JOIN prev ON prev.project = counts.project
            WHERE prev.project IS NULL OR miss_files / total_files >= 0.2),
  m AS (SELECT project, 0 AS kind, []::VARCHAR[] AS key, '{SY.TREE_HEAD}' AS line FROM regen
        UNION ALL SELECT project, 2, []::VARCHAR[], '{SY.FILES_HEAD}' FROM regen
        UNION ALL SELECT project, 1, CASE WHEN node_path = '' THEN []::VARCHAR[] ELSE string_split(node_path, '/') END, line
                  FROM ({ORACLE['tree_lines']}) SEMI JOIN regen USING (project)
        UNION ALL SELECT project, 3, [path], path || ': ' || COALESCE(cached_description, {DESC_SQL})
                  FROM w SEMI JOIN regen USING (project)),
  placed AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY project ORDER BY kind, key
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM m),
  body AS (SELECT project, CAST(floor(pos / {SY.PART_CHARS}) AS BIGINT) AS n, string_agg(line, chr(10) ORDER BY pos) AS material
           FROM placed GROUP BY 1, 2),
  j AS (SELECT project, row_number() OVER (PARTITION BY project ORDER BY n) AS part, count(*) OVER (PARTITION BY project) AS parts,
               material FROM body)
  SELECT project, CAST(part AS INTEGER) AS part, CAST(parts AS INTEGER) AS parts,
         {template_sql(SY.CONTEXT + SY.INSTRUCTIONS + SY.USE_CASES_ASK, SQL_SYNTH_VALUES)} AS use_cases_prompt,
         {template_sql(SY.CONTEXT + SY.CONVENTIONS_ASK, SQL_SYNTH_VALUES)} AS conventions_prompt
  FROM j""")
def q_synthesis_prompts(spark, sf_dir):
    """The project prompts of every gated project, from its whole tree and its
    whole description listing, in parts."""
    from treesnap.session import materialize
    files, cache, merged, _ = _descriptions(spark, sf_dir)
    merged = materialize(merged, "described")  # read by the gate, the tree and the listing
    gate = changes.change_gate(changes.miss_counts(merged), TB.previous_synthesis(cache))
    tree = TR.tree_lines(merged.select("project", "path"))
    return SY.prompts(gate, tree.select("project", "node_path", "line"),
                      merged.select("project", "path", "description"), instructions=SYNTH_INSTRUCTIONS)


# ------------------------------------------- 13. build, write, read, ingest
@register("snapshot_roundtrip", f"""
  WITH fd AS ({ORACLE['file_descriptions']})
  SELECT project, 'file:' || path AS id, path, {py_strip_sql('description')} AS text,
         CAST(count(*) OVER (PARTITION BY project) AS INTEGER) AS file_chunk_count
  FROM fd WHERE {py_strip_sql('description')} <> ''""")
def q_snapshot_roundtrip(spark, sf_dir):
    """The build's documents written (several part files a project), read
    back line by line and ingested: chunks with the registry's count."""
    from treesnap.operators import assemble as A
    from treesnap.session import scratch_path
    out, root = scratch_path(spark, "built"), scratch_path(spark, "roundtrip-state")
    A.write_documents(_build(spark, sf_dir).document_lines, out, partitions=64)
    IG.ingest_built_to(spark, out, root, 0, TB.BATCH_TIMES[0])
    state = IG.load_state(spark, root)
    return state.chunks.join(state.projects.withColumnRenamed("name", "project"), "project").select(
        "project", "id", "path", "text", "file_chunk_count")
