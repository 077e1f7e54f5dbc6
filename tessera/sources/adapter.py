"""The star-schema tables read as a code graph: symbols (nodes), links (typed, confidence-scored edges), and event tables.

Customers are classes, nations interfaces, suppliers methods, parts types, orders functions and regions modules; keys that
refer to another table are links. The SQL is shared by both engines: {s} is the name of the string type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SYMBOLS = """
select 'r' || r_regionkey as id, r_name as name, 'module' as kind, 'src/geo/region.ts' as file_path, 1 as start_line, 10 as end_line, true as exported, cast(null as {s}) as parent_id from {region}
union all select 'n' || n_nationkey, n_name, 'interface', 'src/geo/n' || (n_nationkey % 5) || '.ts', n_nationkey * 10 + 1, n_nationkey * 10 + 9, true, 'r' || n_regionkey from {nation}
union all select 'c' || c_custkey, c_name, 'class', 'src/' || lower(c_mktsegment) || '/c' || (c_custkey % 7) || '.ts', cast(c_custkey * 10 + 1 as int), cast(c_custkey * 10 + 9 as int), c_acctbal > 0, 'n' || c_nationkey from {customer}
union all select 's' || s_suppkey, s_name, 'method', 'src/supply/s' || (s_suppkey % 3) || '.ts', cast(s_suppkey * 10 + 1 as int), cast(s_suppkey * 10 + 9 as int), s_suppkey % 2 = 0, 'n' || s_nationkey from {supplier}
union all select 'p' || p_partkey, p_name, 'type', 'src/parts/' || lower(p_type) || '.ts', cast(p_partkey * 10 + 1 as int), cast(p_partkey * 10 + 9 as int), p_size % 2 = 0, cast(null as {s}) from {part}
union all select 'o' || o_orderkey, 'order_' || o_orderkey, 'function', case when o_orderkey % 10 = 0 then 'test/unit/o' || (o_orderkey % 13) || '.test.ts' else 'src/orders/o' || (o_orderkey % 29) || '.ts' end,
  cast(o_orderkey * 10 + 1 as int), cast(o_orderkey * 10 + 9 as int), o_orderstatus = 'F', cast(null as {s}) from {orders}
"""

#: from_id, to_id, type, confidence. Only line items have repeated edges; keys make the others distinct.
REFERENCES = """
select from_id, to_id, type, (35 + 10 * (n % 7)) / 1e2 as confidence from (
select 'o' || o_orderkey as from_id, 'c' || o_custkey as to_id, 'calls' as type, o_orderkey as n from {orders}
union all select 'c' || c_custkey, 'n' || c_nationkey, 'extends', c_custkey from {customer}
union all select 's' || s_suppkey, 'n' || s_nationkey, 'implements', s_suppkey from {supplier}
union all select 'n' || n_nationkey, 'r' || n_regionkey, 'imports', n_nationkey from {nation}
union all select 'n' || n_nationkey, 'n' || ((n_nationkey * 7 + 3) % 25), 'calls', n_nationkey from {nation}
union all select distinct 'o' || l_orderkey, 'p' || l_partkey, 'references', l_orderkey from {lineitem} where l_linenumber = 1
union all select distinct 'p' || l_partkey, 's' || l_suppkey, 'imports', l_partkey from {lineitem} where l_linenumber = 2 and l_quantity > 40) as edges
"""

CONTAINS = "select parent_id as from_id, id as to_id, 'contains' as type, 1e0 as confidence from ({symbols}) as nodes where parent_id is not null"

#: Time at which relative periods end; just after the events.
NOW = "2024-02-01 00:00:00"

TOOL_USAGE = "select event_id as id, event_type as tool, ts as called_at, cast(floor(value) as int) as duration_ms, event_id % 97 as tokens_out, event_id % 31 as tokens_saved, 'u' || user_id as repo from {events}"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _fill(sql: str, s: str, names: dict[str, str]) -> str:
    return sql.format(s=s, **names)


def spark_names(sf_dir: str) -> dict[str, str]:
    return {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, kind, file_path, start_line, end_line, exported, parent_id)"""
    return spark.sql(_fill(SYMBOLS, "string", spark_names(sf_dir)))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from_id, to_id, type, confidence) of all links but containment."""
    return spark.sql(_fill(REFERENCES, "string", spark_names(sf_dir)))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    contains = _fill(CONTAINS, "string", {"symbols": _fill(SYMBOLS, "string", spark_names(sf_dir))})
    return references(spark, sf_dir).unionAll(spark.sql(contains))


def tool_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_fill(TOOL_USAGE, "string", spark_names(sf_dir)))


def oracle_ctes() -> dict[str, str]:
    """The same tables as common table expressions for a SQL engine that has the driver's tables as views."""
    names = {t: t for t in TABLES}
    symbols_sql, references_sql = _fill(SYMBOLS, "varchar", names), _fill(REFERENCES, "varchar", names)
    contains = CONTAINS.format(symbols="select * from symbols")
    return {"symbols": symbols_sql, "refs": references_sql, "links": f"select * from refs union all {contains}", "tool_usage": _fill(TOOL_USAGE, "varchar", names)}
