"""Registration of queries with the SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.functions import paths
from tessera.sources import adapter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _like(column: str, patterns: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"{column} ilike '{p}'" for p in patterns) + ")"


TEST = "regexp_matches(file_path, '\\.(test|spec)\\.[jt]sx?$|((^|[/\\\\])tests?[/\\\\]|__tests__[/\\\\]).*(?i:\\.(ts|tsx|js|jsx|mjs|cjs|py|go|rb|java|php|rs))$|_test\\.(go|py|rb|rs|java|php)$|(^|/)test_[^/]*\\.py$')"

#: Common table expressions by name; each may use those before it.
CTES = adapter.oracle_ctes() | {
    "seen": "select l.*, s.file_path as from_file from links l left join symbols s on s.id = l.from_id where l.type <> 'contains'",
    "fan": "select min(from_id) as from_id, to_id from seen where from_file is not null group by from_file, to_id union all select from_id, to_id from seen where from_file is null",
    "callers": f"""select to_id as id, count(distinct file_path) filter (rt and not test) as runtime_files, count(distinct file_path) filter (type = 'references') as type_files,
      count(distinct file_path) filter (rt and test) as test_files
      from (select to_id, type, from_file as file_path, type in ('calls', 'imports', 'extends', 'implements') as rt, {TEST.replace("file_path", "from_file")} as test from seen where from_file is not null) x group by to_id""",
    "counted": """select s.*, coalesce(i.n, 0) as fan_in, coalesce(o.n, 0) as fan_out, coalesce(c.runtime_files, 0) as runtime_files, coalesce(c.type_files, 0) as type_files, coalesce(c.test_files, 0) as test_files
      from symbols s left join (select to_id as id, count(*) as n from fan group by 1) i on i.id = s.id left join (select from_id as id, count(*) as n from fan group by 1) o on o.id = s.id left join callers c on c.id = s.id""",
    "roled": """select *, case when kind in ('interface', 'type', 'enum', 'struct') then 'datatype' when exported and fan_in = 0 and fan_out > 0 then 'entrypoint' when fan_in >= 3 and fan_out >= 3 then 'hub'
      when fan_in > 0 and fan_out = 0 then 'leaf' when exported and fan_in between 1 and 2 then 'utility' when exported then 'utility' else 'leaf' end as role,
      cast(least(least(15 * fan_in, 50) + least(5 * fan_out, 25) + case when exported then 10 else 0 end + case when kind in ('function', 'class', 'method') then 5 else 0 end, 100) as bigint) as heat from counted""",
    "enriched": """select *, cast(floor(least(least(18 * log2(runtime_files + 1.0), 55.0) + least(4 * log2(type_files + 1.0), 12.0) + case when exported then 12 else 0 end
      + case when kind in ('function', 'class', 'method') then 6 else 0 end + case when test_files > 0 then 8 else 0 end + case when role = 'entrypoint' then 7 else 0 end, 100.0) + 0.5) as bigint) as importance from roled""",
    "tested": f"select distinct l.to_id as id from links l join symbols s on s.id = l.from_id where {_like('s.file_path', paths.TEST_LIKE)}",
    "file_edges": """select least(f.file_path, t.file_path) as file_a, greatest(f.file_path, t.file_path) as file_b, count(*) as weight from links l join symbols f on f.id = l.from_id join symbols t on t.id = l.to_id
      where l.type <> 'contains' and f.file_path <> t.file_path group by 1, 2""",
    "dependents": "select l.to_id as id, count(distinct s.file_path) as dependents from links l join symbols s on s.id = l.from_id where l.type <> 'contains' group by 1",
    "risk_in": f"""select e.*, coalesce(d.dependents, 0) as dependents, e.id in (select to_id from links l join symbols s on s.id = l.from_id where {TEST.replace("file_path", "s.file_path")}) as tested from enriched e left join dependents d on d.id = e.id""",
    "ann": "select 'u' || user_id as symbol, event_type as key, cast(event_id % 3 as varchar) as value, ts, event_id from events",
}
ORDER = list(CTES)


def sql_with(body: str, extra: dict[str, str] | None = None) -> str:
    """body with the common table expressions that it needs in front. extra: more of them, after the others."""
    all_ = CTES | (extra or {})
    order = [*ORDER, *(extra or {})]
    need: set[str] = set()

    def add(text: str) -> None:
        for name in order:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                add(all_[name])

    add(body)
    used = [n for n in order if n in need]
    return ("WITH RECURSIVE " + ",\n".join(f"{n} as ({all_[n]})" for n in used) + "\n" if used else "") + body


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Registers a query and, if there is one, its SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql_with(sql, extra)
        return f

    return put
