"""Walks over the link graph: level by level with duplicates dropped at every level, or along simple paths of bounded length."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.cut import cut, is_small, small

IMPACT = ("calls", "imports", "extends", "implements", "references")
EXECUTION = ("calls", "extends", "implements")
HIERARCHY = ("extends", "implements")


def walk(links: DataFrame, starts: DataFrame, types: tuple[str, ...], depth: int, up: bool = True) -> DataFrame:
    """(id, depth, via): what reaches starts (id) backwards (up) or forwards by at most depth links of types, each id at every depth at which a walk meets it.

    The depth alone ends a walk around a cycle, so a start can be met again. Unknown starts give nothing. The frontier holds
    distinct ids only, so its size is bounded by the number of symbols, however many walks there are. Each level is written
    once to the shared checkpoint folder. A frontier that a count finds small is broadcast and filters the links as they are
    read; only a wide one has the links of types cut, once, and joined by a shuffle.
    """
    near, far = ("to_id", "from_id") if up else ("from_id", "to_id")
    edges, whole = links.filter(F.col("type").isin(*types)).select(F.col(near).alias("id"), F.col(far).alias("next"), F.col("type").alias("via")).filter("next is not null"), False
    frontier, levels = starts.select("id").distinct(), []
    for d in range(1, depth + 1):
        if not (narrow := is_small(frontier)) and not whole:
            edges, whole = cut(edges.distinct()), True
        level = edges.join(F.broadcast(frontier) if narrow else frontier, "id", "left_semi").select(F.col("next").alias("id"), F.lit(d).alias("depth"), "via").distinct()
        if d < depth:
            level = cut(level)
            if level.isEmpty():
                break
        levels.append(level)
        frontier = level.select("id").distinct()
    return reduce(DataFrame.unionAll, levels) if levels else starts.select("id", F.lit(0).alias("depth"), F.lit("").alias("via")).limit(0)


def hydrate(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """found with name, kind and file_path; ids that no symbol has drop out."""
    return found.join(symbols.select("id", "name", "kind", "file_path"), "id")


def simple_walk(links: DataFrame, starts: DataFrame, types: tuple[str, ...], depth: int) -> DataFrame:
    """(id, depth, via): as `walk` forwards, but along paths that meet no symbol twice; the start itself is not on the path, so a cycle meets it once.

    A path counts by the set of its symbols and its end: the orders in which a set can be walked are one. Each level is cut.
    """
    edges, whole = links.filter(F.col("type").isin(*types)).select(F.col("from_id").alias("id"), F.col("to_id").alias("next"), F.col("type").alias("via")), False
    frontier, levels = starts.select("id", F.array().cast("array<string>").alias("path")).distinct(), []
    for d in range(1, depth + 1):
        if not (narrow := is_small(frontier)) and not whole:
            edges, whole = cut(edges.distinct()), True
        met = edges.join(F.broadcast(frontier) if narrow else frontier, "id").filter(~F.array_contains("path", F.col("next")))
        met = cut(met.select(F.col("next").alias("id"), F.array_sort(F.array_append("path", F.col("next"))).alias("path"), "via").distinct())
        levels.append(met.select("id", F.lit(d).alias("depth"), "via").distinct())
        frontier = met.select("id", "path").distinct()
    return reduce(DataFrame.unionAll, levels)


def steps(links: DataFrame) -> DataFrame:
    """What a path may take: any link that is not containment, forwards, and containment backwards."""
    forward = links.filter("type <> 'contains'").select("from_id", "to_id", "type")
    return forward.unionAll(links.filter("type = 'contains'").select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "type")).distinct()


def shortest_path(links: DataFrame, start: str, end: str, depth: int = 5) -> DataFrame:
    """(path, hops) of the shortest path from start to end of at most depth steps, the first by its ids among equals; no row if there is none.

    A path begins with a link that is not containment, of start or of something that start contains. Paths meet no symbol twice.
    Breadth first: a symbol is met at its least distance only, with its two first paths that differ in the member of start
    that they begin in, since such a path alone cannot go on to that member. So a level has at most two rows a symbol.
    """
    go = steps(links).select(F.col("from_id").alias("at"), F.col("to_id").alias("next"))
    ahead = links.filter("type <> 'contains'").select("from_id", "to_id")
    inside = links.filter((F.col("type") == "contains") & (F.col("from_id") == start)).select(F.col("to_id").alias("from_id")).distinct()
    one = ahead.filter((F.col("from_id") == start) & (F.col("to_id") != start)).select(F.col("to_id").alias("at"), F.lit("").alias("member"), F.array(F.lit(start), F.col("to_id")).alias("path"))
    two = ahead.join(F.broadcast(inside) if is_small(inside) else inside, "from_id").filter((F.col("to_id") != start) & (F.col("to_id") != F.col("from_id")))
    two = two.select(F.col("to_id").alias("at"), F.col("from_id").alias("member"), F.array(F.lit(start), F.col("from_id"), F.col("to_id")).alias("path"))

    def first(rows: DataFrame) -> DataFrame:
        each = rows.groupBy("at", "member").agg(F.min_by("path", F.array_join("path", ">")).alias("path"))
        by = Window.partitionBy("at").orderBy(F.array_join("path", ">"))
        return cut(each.withColumn("r", F.row_number().over(by)).filter("r <= 2").drop("r"))

    seen, frontier = one.select("at").limit(0), first(one)
    for hops in range(1, depth + 1):
        if hops > 1:
            ways = frontier.join(go, "at") if not is_small(frontier) else go.join(F.broadcast(frontier), "at")
            ways = ways.filter(~F.array_contains("path", F.col("next"))).select(F.col("next").alias("at"), "member", F.array_append("path", F.col("next")).alias("path"))
            ways = ways.unionAll(two) if hops == 2 else ways
            frontier = first(ways.join(small(seen), "at", "left_anti"))
        if not frontier.filter(F.col("at") == end).isEmpty() or hops > 1 and frontier.isEmpty():
            break
        seen = cut(seen.unionAll(frontier.select("at")).distinct())
    found = frontier.filter(F.col("at") == end).select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).cast("long").alias("hops"))
    return found.orderBy("hops", "path").limit(1)


def entry_paths(links: DataFrame, symbols: DataFrame, target: str, depth: int = 8, most: int = 5) -> DataFrame:
    """(path, hops): the shortest simple paths from entry points to target along calls and imports, ties by ids.

    An entry point has no caller or importer, and is exported, or a file's module, or a method in an exported class.
    Longer paths are looked for only as long as the shorter ones are fewer than most; each level is cut.
    """
    uses = links.filter("type in ('calls', 'imports')").select("from_id", "to_id")
    classes = symbols.filter("exported").select(F.col("id").alias("from_id"))
    members = links.filter("type = 'contains'").join(classes, "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct().withColumn("member", F.lit(True))
    entries = symbols.join(members, "id", "left").filter("exported or (kind = 'module' and name = '_top') or (kind = 'method' and member)").select(F.col("id").alias("at"))
    frontier = cut(symbols.filter(F.col("id") == target).select(F.array("id").alias("path"), F.col("id").alias("at")))
    levels, n = [], 0
    for hops in range(depth + 1):
        met = frontier.select("at").distinct()
        met = F.broadcast(met) if is_small(met) else met
        called = uses.join(met, uses["to_id"] == met["at"], "left_semi").select(F.col("to_id").alias("at")).distinct()
        level = cut(frontier.join(called, "at", "left_anti").join(entries.join(met, "at", "left_semi"), "at", "left_semi").select("path"))
        levels.append(level)
        n += level.limit(most).count()
        if n >= most or hops == depth:
            break
        ways = uses.withColumnRenamed("to_id", "at").join(F.broadcast(frontier) if is_small(frontier) else frontier, "at").filter(~F.array_contains("path", F.col("from_id")))
        ways = ways.join(symbols.select(F.col("id").alias("from_id")), "from_id", "left_semi")
        frontier = cut(ways.select(F.concat(F.array("from_id"), F.col("path")).alias("path"), F.col("from_id").alias("at")).distinct())
        if frontier.isEmpty():
            break
    found = reduce(DataFrame.unionAll, levels).select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).cast("long").alias("hops"))
    return found.orderBy("hops", "path").limit(most)


def neighbours(links: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, other): distinct ends of a symbol's links that are not containment, with those of the members of a class, struct or trait."""
    flat = links.filter("type <> 'contains'")
    own = flat.select(F.col("from_id").alias("id"), F.col("to_id").alias("other")).unionAll(flat.select(F.col("to_id").alias("id"), F.col("from_id").alias("other")))
    holders = symbols.filter("kind in ('class', 'struct', 'trait')").select(F.col("id").alias("from_id"))
    members = links.filter("type = 'contains'").join(holders, "from_id", "left_semi").select(F.col("from_id").alias("holder"), F.col("to_id").alias("id")).distinct()
    return own.unionAll(own.join(members, "id").select(F.col("holder").alias("id"), "other")).distinct()


def candidates(near: DataFrame, target: str) -> DataFrame:
    """(id, shared): the symbols that share neighbours (id, other) with target, and how many."""
    mine = near.filter(F.col("id") == target).select("other").distinct()
    return near.filter(F.col("id") != target).join(mine, "other", "left_semi").groupBy("id").agg(F.count("*").alias("shared"))


def similar(links: DataFrame, symbols: DataFrame, target: str, least: float = 0.15, most: int = 10) -> DataFrame:
    """(id, similarity): exported symbols by the Jaccard similarity of their neighbours to target's. Candidates come from a join on shared neighbours, not from all symbols."""
    near = cut(neighbours(links, symbols))
    mine = near.filter(F.col("id") == target).select("other").distinct()
    size = near.groupBy("id").agg(F.count("*").alias("size"))
    shared = candidates(near, target)
    mine_size = mine.agg(F.count("*").alias("mine"))
    found = shared.join(size, "id").crossJoin(mine_size).join(symbols.filter("exported").select("id"), "id", "left_semi")  # mine_size is one row
    similarity = F.col("shared") / (F.col("size") + F.col("mine") - F.col("shared"))
    return found.select("id", similarity.alias("s")).filter(F.col("s") >= least).select("id", (F.floor(F.col("s") * 100 + 0.5) / 100).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(most)
