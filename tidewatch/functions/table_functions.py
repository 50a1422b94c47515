"""The resolvers as SQL table functions, for authors of checks who write SQL.

register() makes them temporary functions of a session over given event tables:

    latest_readings(paths, as_of, hours)          window_stats(paths, as_of, hours)
    latest_flags(paths, true_values, as_of, hours)  path_presence(paths, recent_hours, as_of, hours)
    latest_fixes(lat_paths, lon_paths, as_of, hours)  event_window(as_of, hours)

paths: array of dotted names, the first that is there counts; segments that are numbers are all keys or all indexes. as_of: timestamp.
All but event_window end with two more parameters, profiles (array) and name_like, null for any device. The rows are those of the resolvers of the same
names; arguments are literals to the optimiser, so that windows reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from .payload import DECIMAL_TEXT, READING

UPLINKS = "tidewatch_uplinks"
#: Candidates of a call whose paths become literals.
UNROLLED = 6
_DEVICE = "dev_eui STRING, device_name STRING"


def _leaf(path: str, kind: str) -> str:
    """SQL for a leaf of the payload v at a dotted path. For a literal path its spellings are literals too, parsed once."""
    key = f"concat('$[\"', replace({path}, '.', '\"][\"'), '\"]')"
    index = f"regexp_replace({key}, r'\\[\"0*([0-9]{{1,9}})\"\\]', '[$1]')"
    get = lambda spelled: f"try_variant_get(v, {spelled}, '{kind}')"
    return f"CASE WHEN {key} = {index} THEN {get(key)} ELSE coalesce({get(key)}, {get(index)}) END"


def _number(path: str) -> str:
    kind, text = f"schema_of_variant({_leaf(path, 'variant')})", _leaf(path, "string")
    return (
        f"CASE WHEN {kind} RLIKE '^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)' THEN {_leaf(path, READING)} "
        f"WHEN {kind} = 'STRING' AND {text} RLIKE r'{DECIMAL_TEXT}' THEN try_cast({text} AS {READING}) END"
    )


def _each(paths: str, value: Callable[[str], str]) -> str:
    """SQL for an array of (ord, path, value) of the candidates; value is null where one has none.

    The first UNROLLED candidates are expressions of their own, which the optimiser folds to literal paths or, beyond the array's
    end, to null. Any more go through a lambda, whose paths are spelled and parsed for each row.
    """
    entry = lambda i, p: f"named_struct('ord', {i}, 'path', {p}, 'value', {value(p)})"
    first = [f"CASE WHEN size({paths}) > {i} THEN {entry(i, f'try_element_at({paths}, {i + 1})')} END" for i in range(UNROLLED)]
    rest = f"transform(slice({paths}, {UNROLLED + 1}, size({paths})), (p, i) -> {entry(f'i + {UNROLLED}', 'p')})"
    return f"CASE WHEN size({paths}) > {UNROLLED} THEN concat(array({', '.join(first)}), {rest}) ELSE array({', '.join(first)}) END"


def _first(paths: str, value: Callable[[str], str]) -> str:
    return f"try_element_at(filter({_each(paths, value)}, x -> x.value IS NOT NULL), 1)"


def _bodies(kind: str, days: bool) -> dict[str, tuple[str, str, str]]:
    """Name to (parameters, columns, query)."""
    start, end = f"CAST(as_of AS {kind}) - make_dt_interval(0, 0, 0, hours * 3600)", f"CAST(as_of AS {kind})"
    window = f"time > {start} AND time <= {end}" + (f" AND day >= to_date({start}) AND day <= to_date({end})" if days else "")
    scope = "(profiles IS NULL OR array_contains(profiles, device_profile_name)) AND (name_like IS NULL OR device_name LIKE name_like)"
    seen = f"FROM {UPLINKS} WHERE {window} AND {scope}"
    text = lambda path: _leaf(path, "string")
    newest = (
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dev_eui ORDER BY time DESC, deduplication_id DESC) AS n {seen} AND object IS NOT NULL) WHERE n = 1"
    )
    parsed = f"SELECT *, try_parse_json(object) AS v FROM ({newest})"
    tail = "as_of TIMESTAMP, hours DOUBLE DEFAULT 24, profiles ARRAY<STRING> DEFAULT NULL, name_like STRING DEFAULT NULL"
    # The array stands in inline() itself: of a column, Spark infers a filter on its size, which parses the payload once for each use.
    readings = (
        f"SELECT * FROM (SELECT dev_eui, device_name, time, deduplication_id, inline({_each('paths', _number)}) "
        f"FROM (SELECT *, try_parse_json(object) AS v {seen} AND object IS NOT NULL)) WHERE value IS NOT NULL"
    )
    by_path = """SELECT dev_eui, ord, max(device_name) AS device_name, min(value) AS lo, max(value) AS hi, sum(CAST(value AS DECIMAL(38,12))) AS total,
        min_by(value, struct(time, deduplication_id)) AS one, max_by(value, struct(time, deduplication_id)) AS last, count(*) AS n, count(DISTINCT value) AS different,
        min(time) AS a, max(time) AS b"""
    recent = f"time > CAST(as_of AS {kind}) - make_dt_interval(0, 0, 0, recent_hours * 3600)"
    return {
        "event_window": ("as_of TIMESTAMP, hours DOUBLE DEFAULT 24", f"{_DEVICE}, time {kind}, deduplication_id STRING, object STRING", f"SELECT dev_eui, device_name, time, deduplication_id, object FROM {UPLINKS} WHERE {window}"),
        "latest_readings": (
            f"paths ARRAY<STRING>, {tail}", f"{_DEVICE}, matched_path STRING, value DOUBLE, at {kind}",
            f"SELECT dev_eui, device_name, r.path, CAST(r.value AS DOUBLE), time FROM (SELECT *, {_first('paths', _number)} AS r FROM ({parsed})) WHERE r IS NOT NULL",
        ),
        "latest_flags": (
            f"paths ARRAY<STRING>, true_values ARRAY<STRING>, {tail}", f"{_DEVICE}, matched_path STRING, raw STRING, value BOOLEAN, at {kind}",
            f"SELECT dev_eui, device_name, r.path, r.value, array_contains(transform(true_values, x -> lower(x)), lower(r.value)), time FROM (SELECT *, {_first('paths', text)} AS r FROM ({parsed})) WHERE r IS NOT NULL",
        ),
        "latest_fixes": (
            f"lat_paths ARRAY<STRING>, lon_paths ARRAY<STRING>, {tail}", f"{_DEVICE}, lat DOUBLE, lon DOUBLE, at {kind}",
            f"SELECT dev_eui, device_name, CAST(x.value AS DOUBLE), CAST(y.value AS DOUBLE), time FROM (SELECT *, {_first('lat_paths', _number)} AS x, {_first('lon_paths', _number)} AS y FROM ({parsed})) WHERE x IS NOT NULL AND y IS NOT NULL",
        ),
        "window_stats": (
            f"paths ARRAY<STRING>, {tail}",
            f"{_DEVICE}, matched_path STRING, vmin DOUBLE, vmax DOUBLE, vavg DOUBLE, vfirst DOUBLE, vlast DOUBLE, samples BIGINT, distinct_values BIGINT, first_at {kind}, last_at {kind}",
            f"""SELECT dev_eui, device_name, element_at(paths, ord + 1), CAST(lo AS DOUBLE), CAST(hi AS DOUBLE), CAST(round(total / n, 4) AS DOUBLE), CAST(one AS DOUBLE), CAST(last AS DOUBLE), n, different, a, b
            FROM (SELECT *, min(ord) OVER (PARTITION BY dev_eui) AS least FROM ({by_path} FROM ({readings}) GROUP BY dev_eui, ord)) WHERE ord = least""",
        ),
        "path_presence": (
            f"paths ARRAY<STRING>, recent_hours DOUBLE, {tail}", f"{_DEVICE}, matched_path STRING, ever_seen BIGINT, recent_seen BIGINT, recent_uplinks BIGINT, last_seen_at {kind}",
            f"""SELECT dev_eui, device_name, element_at(paths, ord + 1), ever, now, ups, last FROM (
              SELECT dev_eui, ord, count(*) AS ever, count_if(recent) AS now, max(time) AS last, min(ord) OVER (PARTITION BY dev_eui) AS least
              FROM (SELECT dev_eui, time, recent, inline({_each('paths', text)}) FROM (SELECT dev_eui, time, {recent} AS recent, try_parse_json(object) AS v {seen})) WHERE value IS NOT NULL
              GROUP BY dev_eui, ord)
            JOIN (SELECT dev_eui AS eui, max(device_name) AS device_name, count_if(recent) AS ups FROM (SELECT dev_eui, device_name, {recent} AS recent {seen}) GROUP BY dev_eui) ON eui = dev_eui
            WHERE ord = least""",
        ),
    }


def register(spark: SparkSession, tables: Mapping[str, DataFrame]) -> list[str]:
    """Make (or replace) the functions over tables["event_up"]; their names."""
    up = tables["event_up"]
    up.createOrReplaceTempView(UPLINKS)
    bodies = _bodies(up.schema["time"].dataType.simpleString(), "day" in up.columns)
    for name, (parameters, columns, query) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {query}")
    return list(bodies)
