"""An index run as a whole: which facts are read again, what is pruned, when metadata and the search index are written anew."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import enrich, tables, textsearch
from tessera.plans.cut import cut, small


class Run:
    """What a run leaves: symbols with their metadata, links, whether aggregate metadata and the search index are written, and the changes of files.

    Symbols, links and metadata are worked out once each, when they are first asked for.
    """

    def __init__(self, symbols: Callable[[], DataFrame], links: Callable[[], DataFrame], changes: DataFrame, writes_meta: bool, rebuilds_search: bool):
        self._symbols, self._links, self.changes, self.writes_meta, self.rebuilds_search = symbols, links, changes, writes_meta, rebuilds_search

    @cached_property
    def symbols(self) -> DataFrame:
        return cut(self._symbols())

    @cached_property
    def links(self) -> DataFrame:
        return cut(self._links())

    @cached_property
    def enriched(self) -> DataFrame:
        return enrich.enrich(self.symbols, self.links)


def update(stored_symbols: DataFrame, stored_links: DataFrame, new_symbols: DataFrame, new_links: DataFrame, files: DataFrame, hashes: DataFrame, full: bool = False, subset: bool = False) -> Run:
    """The index after files (path, hash) were compared with hashes (path, hash) of the last run.

    full takes every file as changed. An empty tree empties the index; a full run, and one over the whole tree (not subset),
    drop what files that are gone had; a run over a subset drops nothing but what it reads again. Facts of changed files
    come from new_symbols and new_links, links going with the file of their source. The whole graph is enriched again, since a
    changed file moves the counts of others. Aggregate metadata is written after a full run, or if a file was read.
    """
    changes = cut(files.select("path", F.lit("changed").alias("change")) if full else tables.changed_files(files, hashes))
    read = changes.filter("change in ('new', 'changed')").select("path")
    gone = changes.filter("change = 'gone'").select("path") if not full else hashes.join(files.select("path"), "path", "left_anti").select("path")
    empty = files.isEmpty() and not subset
    gone = gone.limit(0) if subset else gone
    as_files = lambda rows: small(rows.withColumnRenamed("path", "file_path"))
    source = lambda links, symbols: links.join(symbols.select(F.col("id").alias("from_id"), "file_path"), "from_id", "left")

    def symbols() -> DataFrame:
        kept = stored_symbols.limit(0) if empty else stored_symbols.join(as_files(read.unionAll(gone)), "file_path", "left_anti")
        return kept.unionByName(new_symbols.join(as_files(read), "file_path", "left_semi").select(*kept.columns))

    def links() -> DataFrame:
        columns = stored_links.columns
        old = stored_links.limit(0) if empty else source(stored_links, stored_symbols).join(as_files(read.unionAll(gone)), "file_path", "left_anti").select(*columns)
        every = old.unionByName(source(new_links, new_symbols).join(as_files(read), "file_path", "left_semi").select(*columns))
        lost = small(cut(stored_symbols.join(as_files(gone), "file_path", "left_semi").select(F.col("id").alias("to_id"))))
        return every.join(lost, "to_id", "left_anti")

    return Run(symbols, links, changes, full or not read.isEmpty(), full)


def search_index(stored: DataFrame, symbols: DataFrame, gone: DataFrame, rebuild: bool) -> DataFrame:
    """(id, term) over name, file_path and kind of symbols: on a rebuild all of them, otherwise the stored rows without the ids in gone (id) and with those of symbols in place of theirs."""
    terms = symbols.select("id", F.explode(F.array_distinct(textsearch.tokens(F.concat_ws(" ", "name", "file_path", "kind")))).alias("term"))
    if rebuild:
        return terms
    return stored.join(gone.select("id").unionAll(symbols.select("id")).distinct(), "id", "left_anti").unionByName(terms)


def scope_lookup(names: DataFrame, scopes: DataFrame, declared: DataFrame) -> DataFrame:
    """(key, target_id, confidence): the declaration that a name (key, scope, name, file_path) sees, in its scope or the nearest one around it.

    scopes: scope, parent; declared: scope, name, id, file_path. A target in the same file has .95, another .85. The walk ends
    when every name has found its target or left the outermost scope.
    """
    d = declared.groupBy("scope", "name").agg(F.min_by(F.struct("id", "file_path"), "id").alias("d"))
    at, found = cut(names.select("key", "scope", "name", "file_path", F.array("scope").alias("seen"))), []
    while not at.isEmpty():
        met = at.join(d, ["scope", "name"], "left")
        found.append(cut(met.filter("d is not null").select("key", F.col("d.id").alias("target_id"), F.when(F.col("d.file_path") == F.col("file_path"), 0.95).otherwise(0.85).alias("confidence"))))
        up = met.filter("d is null").drop("d").join(scopes, "scope").filter(F.col("parent").isNotNull() & ~F.array_contains("seen", F.col("parent")))
        at = cut(up.select("key", F.col("parent").alias("scope"), "name", "file_path", F.array_append("seen", F.col("parent")).alias("seen")))
    out = names.select("key", F.lit(None).cast("string").alias("target_id"), F.lit(None).cast("double").alias("confidence")).limit(0)
    for part in found:
        out = out.unionAll(part)
    return out
