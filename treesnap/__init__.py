"""Corpus snapshots and search on Spark DataFrames.

Modules:
    session              tuned local session, checkpoint folder, lineage cuts, bounded broadcasts
    functions.text       strip, line counts, sentence budget, sha256, token estimate
    functions.paths      parts, parent, suffix, node ids, slugs, lexical normalisation
    functions.globs      gitignore-style patterns compiled to rlike predicates
    functions.imports    JS/TS regex and Python AST import extractors, parser registry
    sources.files        the "tree" data source (directory trees as (project, path, content))
    sources.snapshots    pushed snapshot documents parsed through VARIANT
    sources.cache        readers for per-project cache and synthesis JSON files
    sources.tables       inputs derived from the driver's tables
    operators.changes    hash, cache lookup, pending work, merge, miss counts, change gate
    operators.tree       directory nodes, edges, text tree, diagram lines
    operators.deps       dependency extraction, candidate resolution, edges, diagram lines
    operators.describe   description / embedding model helpers and stand-ins
    operators.synthesis  project prompts and model calls
    operators.assemble   snapshot document lines and writer
    operators.registry   upserts, overview extraction, lookups, listing, collections
    operators.search     exact top-k vector search
    operators.usage      token usage sums
    plans.build          the batch build
    plans.catalog        registered queries and their oracle SQL
    streaming.ingest     batch and Structured Streaming ingest of snapshots
"""
