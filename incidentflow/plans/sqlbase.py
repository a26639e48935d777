"""Common table expressions for the DuckDB oracle.

They rebuild the derived tables from the raw views independently of the Spark
code so that each registered query can be compared value by value.
"""

from .. import constants as K
from ..sources.fixtures import FIXTURE_CAUSES


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(_q(x) for x in items) + "]"


D = "CAST({} AS DOUBLE)".format

PEAK = "(" + ", ".join(str(h) for h in K.PEAK_HOURS) + ")"

CAUSE_WEIGHT_CASE = ("CASE lower(event_cause) "
                     + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in K.CAUSE_WEIGHTS.items())
                     + f" ELSE {K.DEFAULT_CAUSE_WEIGHT} END")
DISPLAY_WEIGHT_CASE = ("CASE lower(event_cause) "
                       + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in K.DISPLAY_CAUSE_WEIGHTS.items())
                       + f" ELSE {K.DEFAULT_DISPLAY_WEIGHT} END")


def score_sql(base: str, priority="priority", closure="requires_road_closure",
              corridor="corridor", peak="is_peak_hour") -> str:
    return (f"(CAST({base} AS DOUBLE)"
            f" * CASE WHEN {priority} = 'High' THEN {D(K.PRIORITY_MULT)} ELSE 1.0::DOUBLE END"
            f" * CASE WHEN {closure} THEN {D(K.CLOSURE_MULT)} ELSE 1.0::DOUBLE END"
            f" * CASE WHEN {corridor} <> 'Non-corridor' THEN {D(K.CORRIDOR_MULT)} ELSE 1.0::DOUBLE END"
            f" * CASE WHEN {peak} = 1 THEN {D(K.PEAK_MULT)} ELSE 1.0::DOUBLE END)")


def severity_sql(score: str) -> str:
    return (f"CASE WHEN {score} < 3.0 THEN 'Low' WHEN {score} < 5.0 THEN 'Medium' "
            f"WHEN {score} < 7.0 THEN 'High' ELSE 'Critical' END")


def ts_text(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


PLAN_ROWS = ", ".join(
    f"({_q(s)}, {o}, {b}, {str(d).upper()}, {_q(bt)}, {_q(dt)})" for s, o, b, d, bt, dt in K.RESOURCE_PLAN)


def plan_int(sev: str, idx: int) -> str:
    parts = " ".join(f"WHEN {sev} = {_q(r[0])} THEN {r[idx]}" for r in K.RESOURCE_PLAN)
    fb = [r for r in K.RESOURCE_PLAN if r[0] == K.PLAN_FALLBACK][0][idx]
    return f"CASE {parts} ELSE {fb} END"


def plan_text_sql(sev: str, idx: int) -> str:
    parts = " ".join(f"WHEN {sev} = {_q(r[0])} THEN {_q(r[idx])}" for r in K.RESOURCE_PLAN)
    fb = [r for r in K.RESOURCE_PLAN if r[0] == K.PLAN_FALLBACK][0][idx]
    return f"CASE {parts} ELSE {_q(fb)} END"


INC = f"""
inc AS (
  SELECT
    e.event_id AS incident_id,
    CASE WHEN e.event_id % 53 = 0 THEN NULL
         WHEN e.event_type IN ('purchase', 'signup') THEN 'planned' ELSE 'unplanned' END AS event_type,
    ({_list(FIXTURE_CAUSES)})[CAST((e.event_id * 7 + e.user_id) % 14 AS INTEGER) + 1] AS event_cause,
    CASE WHEN e.event_id % 10 = 0 THEN NULL WHEN e.value >= 60 THEN 'High' ELSE 'Low' END AS priority,
    CASE WHEN e.event_id % 11 = 0 THEN NULL ELSE e.event_id % 5 = 0 END AS requires_road_closure,
    CASE WHEN e.user_id % 9 = 8 THEN NULL ELSE 'Corridor ' || CAST(e.user_id % 9 AS VARCHAR) END AS corridor,
    CASE WHEN e.user_id % 37 = 0 THEN NULL ELSE n.n_name END AS police_station,
    CASE WHEN CAST(json_extract_string(e.props, '$.k') AS INTEGER) % 10 = 9 THEN NULL
         ELSE 'Junc' || CAST((e.user_id % 25) * 4 + CAST(json_extract_string(e.props, '$.k') AS INTEGER) % 4 AS VARCHAR)
    END AS junction,
    CASE WHEN e.event_id % 41 = 0 THEN NULL WHEN e.event_id % 211 = 0 THEN 0.0::DOUBLE
         ELSE CAST(127600 + (e.user_id % 25) * 160 + (e.event_id * 7919) % 600 AS DOUBLE) / 10000.0::DOUBLE
    END AS latitude,
    CAST(773800 + (((e.user_id % 25) * 7) % 25) * 160 + (e.event_id * 104729) % 600 AS DOUBLE) / 10000.0::DOUBLE
      AS longitude,
    CASE WHEN e.event_id % 97 = 0 THEN NULL ELSE e.ts END AS start_datetime,
    CASE WHEN e.event_id % 13 = 0 THEN NULL
         WHEN e.event_id % 101 = 0 THEN e.ts - INTERVAL 1 HOUR
         ELSE e.ts + to_seconds(CAST(floor(e.value * 600) AS BIGINT)) END AS closed_datetime
  FROM events e LEFT JOIN nation n ON n.n_nationkey = e.user_id % 25
)"""

FILLED = """
filled AS (
  SELECT incident_id, event_type,
         coalesce(event_cause, 'others') AS event_cause,
         coalesce(priority, 'Low') AS priority,
         coalesce(requires_road_closure, false) AS requires_road_closure,
         coalesce(corridor, 'Non-corridor') AS corridor,
         coalesce(police_station, 'Unknown') AS police_station,
         junction, latitude, longitude, start_datetime, closed_datetime
  FROM inc
)"""

SERVE = """
serve AS (
  SELECT * FROM filled
  WHERE latitude IS NOT NULL AND longitude IS NOT NULL
    AND latitude > 12.8 AND latitude < 13.2 AND longitude > 77.4 AND longitude < 77.8
)"""

TRAIN = f"""
train0 AS (
  SELECT *, CAST(hour(start_datetime) AS INTEGER) AS hour,
         CAST(isodow(start_datetime) - 1 AS INTEGER) AS day_of_week,
         CAST(month(start_datetime) AS INTEGER) AS month,
         CAST(coalesce(hour(start_datetime) IN {PEAK}, false) AS INTEGER) AS is_peak_hour
  FROM filled WHERE start_datetime IS NOT NULL
),
train1 AS (
  SELECT *, {score_sql(CAUSE_WEIGHT_CASE)} AS congestion_score FROM train0
),
train AS (
  SELECT *, {severity_sql('congestion_score')} AS congestion_severity FROM train1
)"""

FB = f"""
fb0 AS (
  SELECT f.*, CAST(hour(start_datetime) AS INTEGER) AS _hour,
         CAST(isodow(start_datetime) - 1 AS INTEGER) AS _dow,
         {severity_sql(score_sql(CAUSE_WEIGHT_CASE, peak=f"CAST(coalesce(hour(start_datetime) IN {PEAK}, false) AS INTEGER)"))} AS _pred
  FROM filled f
  WHERE start_datetime IS NOT NULL
),
fb AS (
  SELECT
    incident_id AS seq,
    'EVT-' || CAST(incident_id AS VARCHAR) AS event_id,
    event_cause,
    _pred AS predicted_severity,
    CAST(30 + (incident_id * 8) % 120 AS DOUBLE) AS predicted_duration,
    CASE WHEN incident_id % 12 = 0 THEN
      CASE _pred WHEN 'Low' THEN 'Medium' WHEN 'Medium' THEN 'High' ELSE 'Critical' END
      ELSE _pred END AS actual_severity,
    greatest(15.0::DOUBLE, CAST(30 + (incident_id * 8) % 120 AS DOUBLE)
                           + CAST((incident_id * 13) % 41 - 20 AS DOUBLE)) AS actual_duration,
    CAST({plan_int('_pred', 1)} AS INTEGER) AS recommended_officers,
    CAST(greatest(1, {plan_int('_pred', 1)} + (incident_id * 3) % 5 - 2) AS INTEGER) AS actual_officers,
    CAST({plan_int('_pred', 2)} AS INTEGER) AS recommended_barricades,
    CAST(greatest(0, {plan_int('_pred', 2)} + (incident_id * 7) % 5 - 2) AS INTEGER) AS actual_barricades,
    CASE WHEN 1 + (incident_id * 7) % 5 >= 3 THEN 'yes' ELSE 'no' END AS diversion_effective,
    CAST(1 + (incident_id * 7) % 5 AS INTEGER) AS rating,
    start_datetime AS "timestamp",
    CASE WHEN incident_id % 20 = 0 THEN NULL ELSE event_type END AS event_type,
    CASE WHEN incident_id % 20 = 0 THEN NULL ELSE requires_road_closure END AS requires_road_closure,
    CASE WHEN incident_id % 20 = 0 THEN NULL ELSE priority END AS priority,
    CASE WHEN incident_id % 20 = 0 THEN NULL ELSE corridor END AS corridor,
    CASE WHEN incident_id % 20 = 0 THEN NULL ELSE police_station END AS police_station,
    CASE WHEN incident_id % 20 = 0 THEN NULL ELSE _hour END AS hour,
    CASE WHEN incident_id % 20 = 0 THEN NULL ELSE _dow END AS day_of_week
  FROM fb0
)"""

REQ = """
req AS (
  SELECT incident_id AS request_id, event_type, event_cause, requires_road_closure, priority,
         corridor, police_station, latitude, longitude,
         CAST(hour(start_datetime) AS INTEGER) AS hour,
         CAST(isodow(start_datetime) - 1 AS INTEGER) AS day_of_week,
         latitude + 0.0005::DOUBLE AS dest_lat, longitude + (-0.001)::DOUBLE AS dest_lng
  FROM filled
  WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND start_datetime IS NOT NULL
)"""


def with_ctes(*ctes: str) -> str:
    """``WITH`` clause of the named CTE blocks in dependency order."""
    return "WITH " + ",".join(ctes)


BASE_INC = with_ctes(INC)
BASE_FILLED = with_ctes(INC, FILLED)
BASE_SERVE = with_ctes(INC, FILLED, SERVE)
BASE_TRAIN = with_ctes(INC, FILLED, TRAIN)
BASE_FB = with_ctes(INC, FILLED, FB)
BASE_REQ = with_ctes(INC, FILLED, REQ)
BASE_ALL = with_ctes(INC, FILLED, SERVE, TRAIN, FB, REQ)


# --- spatial dimensions ------------------------------------------------------
def m(c: str) -> str:
    """Mean summed as integer micro-degrees (exact, order-free)."""
    return (f"CAST(sum(CAST(round({c} * 1000000.0::DOUBLE) AS BIGINT)) AS DOUBLE)"
            f" / CAST(count({c}) AS DOUBLE) / 1000000.0::DOUBLE")


WPTS = f"""
wpts AS (
  SELECT * FROM train
  WHERE latitude IS NOT NULL AND longitude IS NOT NULL
    AND latitude > 12.0 AND latitude < 14.0 AND longitude > 77.0 AND longitude < 78.5
),
sdim AS (
  SELECT police_station AS name, {m('latitude')} AS lat, {m('longitude')} AS lng FROM wpts
  WHERE police_station IS NOT NULL GROUP BY 1
  UNION ALL SELECT 'default', 12.9716::DOUBLE, 77.5946::DOUBLE
),
jdim AS (
  SELECT junction AS name, {m('latitude')} AS lat, {m('longitude')} AS lng FROM wpts
  WHERE junction IS NOT NULL GROUP BY 1
)"""


def top_junctions_sql(key: str, name: str) -> str:
    return f"""
{name}_c AS (
  SELECT {key}, junction, count(*) AS n FROM serve
  WHERE junction IS NOT NULL AND {key} IS NOT NULL GROUP BY 1, 2
),
{name}_r AS (
  SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY n DESC, junction) AS INTEGER) AS rank,
         junction, n FROM {name}_c
),
{name} AS (
  SELECT {key}, list(junction ORDER BY rank) AS arr FROM {name}_r WHERE rank <= 3 GROUP BY 1
)"""


SUGG = (top_junctions_sql("police_station", "tj_st") + "," + top_junctions_sql("corridor", "tj_co") + f""",
sugg AS (
  SELECT f.*, coalesce(s.arr, c.arr, {_list(K.FALLBACK_JUNCTIONS)}) AS suggested,
         CASE WHEN s.arr IS NOT NULL THEN 'station' WHEN c.arr IS NOT NULL THEN 'corridor'
              ELSE 'default' END AS junction_source
  FROM fc f LEFT JOIN tj_st s ON s.police_station = f.police_station
            LEFT JOIN tj_co c ON c.corridor = f.corridor
)""")

DUR = "date_diff('microsecond', start_datetime, closed_datetime) / 60000000.0::DOUBLE"


def calibrate_sql(d: str, cause: str = "event_cause") -> str:
    from ..functions.numeric import exact_round_sql
    return (f"greatest(10.0::DOUBLE, " + exact_round_sql(f"CASE "
            f"WHEN lower({cause}) = 'vehicle_breakdown' AND {d} > 180.0 THEN 45.0::DOUBLE + fmod({d}, 60.0::DOUBLE) "
            f"WHEN lower({cause}) = 'accident' AND {d} > 240.0 THEN 60.0::DOUBLE + fmod({d}, 90.0::DOUBLE) "
            f"ELSE {d} END", 1) + ")")


FC = f"""
fc0 AS (
  SELECT r.*, {severity_sql(score_sql(CAUSE_WEIGHT_CASE, peak=f"CAST(coalesce(hour IN {PEAK}, false) AS INTEGER)"))}
           AS predicted_severity
  FROM req r
),
durb AS (
  SELECT event_cause, congestion_severity AS predicted_severity, avg({DUR}) AS base_d FROM train
  WHERE closed_datetime IS NOT NULL AND {DUR} > 0 AND {DUR} < 2880 GROUP BY 1, 2
),
fc AS (
  SELECT fc0.*, {calibrate_sql('coalesce(durb.base_d, 60.0::DOUBLE)', 'fc0.event_cause')} AS predicted_duration_minutes
  FROM fc0 LEFT JOIN durb ON durb.event_cause = fc0.event_cause
                         AND durb.predicted_severity = fc0.predicted_severity
)"""


def _angle(i: int) -> str:
    return (f"({i}.0::DOUBLE * 3.141592653589793::DOUBLE + CAST(CAST('0x' || substr(md5(CAST(request_id AS VARCHAR) || '-{i}'), 1, 8) AS BIGINT) AS DOUBLE)"
            f" / 4294967296.0::DOUBLE * 0.5::DOUBLE)") if i else (
            f"(0.0::DOUBLE + CAST(CAST('0x' || substr(md5(CAST(request_id AS VARCHAR) || '-{i}'), 1, 8) AS BIGINT) AS DOUBLE)"
            f" / 4294967296.0::DOUBLE * 0.5::DOUBLE)")


def _point(i: int) -> str:
    p = f"p{i + 1}"
    dist = f"{K.OFFSET_BASE_DIST + i * K.OFFSET_STEP_DIST}::DOUBLE"
    known = f"({p}j.lat IS NOT NULL AND {p}j.lng IS NOT NULL)"
    return f"""
    CASE WHEN {p}_name IS NULL THEN NULL WHEN {known} THEN {p}j.lat
         ELSE latitude + {dist} * sin({_angle(i)}) END AS {p}_lat,
    CASE WHEN {p}_name IS NULL THEN NULL WHEN {known} THEN {p}j.lng
         ELSE longitude + {dist} * cos({_angle(i)}) END AS {p}_lng,
    CASE WHEN {p}_name IS NULL THEN NULL
         ELSE 'Diversion Point {i + 1} - Reroute target' ||
              CASE WHEN {known} THEN ' (' || {p}_name || ' centroid)' ELSE ' (Estimated offset)' END END AS {p}_role"""


BP = f"""
bp0 AS (SELECT *, suggested[1] AS p1_name, suggested[2] AS p2_name FROM sugg),
bp AS (
  SELECT bp0.*,
    CAST({plan_int('predicted_severity', 1)} AS INTEGER) AS officers,
    CAST({plan_int('predicted_severity', 2)} AS INTEGER) AS barricades,
    CASE predicted_severity WHEN 'Low' THEN false ELSE true END AS diversion_required,
    {plan_text_sql('predicted_severity', 4)} AS barricade_description,
    {plan_text_sql('predicted_severity', 5)} AS diversion_description,
    'EVT-' || CAST(CAST('0x' || substr(md5(CAST(request_id AS VARCHAR)), 1, 8) AS BIGINT) % 90000 + 10000 AS VARCHAR)
      AS event_id,{_point(0)},{_point(1)}
  FROM bp0 LEFT JOIN jdim p1j ON p1j.name = bp0.p1_name LEFT JOIN jdim p2j ON p2j.name = bp0.p2_name
)"""


BASE_GEO = with_ctes(INC, FILLED, SERVE, TRAIN, WPTS)
BASE_BP = with_ctes(INC, FILLED, SERVE, TRAIN, REQ, WPTS, FC, SUGG, BP)


def title_sql(c: str, all_underscores: bool = True) -> str:
    """Word-start upper-casing for lower-case words separated by spaces (oracle side)."""
    src = f"replace({c}, '_', ' ')" if all_underscores else f"regexp_replace({c}, '^([^_]*)_', '\\1 ')"
    return f"array_to_string(list_transform(string_split({src}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


from ..functions.numeric import exact_round_sql  # noqa: E402

ATTR = f"""
a0 AS (
  SELECT seq, event_cause, hour, requires_road_closure, priority, corridor,
         predicted_duration AS dur, CAST({DISPLAY_WEIGHT_CASE} AS DOUBLE) AS b,
         hour IN {PEAK} AS pk, requires_road_closure AS cl,
         priority = 'High' AS hi, corridor <> 'Non-corridor' AS co
  FROM (SELECT seq, coalesce(event_cause, 'others') AS event_cause, coalesce(hour, 12) AS hour,
               coalesce(requires_road_closure, false) AS requires_road_closure,
               coalesce(priority, 'Low') AS priority, coalesce(corridor, 'Non-corridor') AS corridor,
               predicted_duration FROM fb)
),
a1 AS (
  SELECT *, b AS a_cause,
         CASE WHEN pk THEN b * 0.25::DOUBLE ELSE 0.0::DOUBLE END AS a_peak,
         CASE WHEN cl THEN b * 0.5::DOUBLE ELSE 0.0::DOUBLE END AS a_closure,
         CASE WHEN hi THEN b * 0.3::DOUBLE ELSE 0.0::DOUBLE END AS a_priority,
         CASE WHEN co THEN b * 0.2::DOUBLE ELSE b * 0.05::DOUBLE END AS a_corridor
  FROM a0
),
a2 AS (SELECT *, a_cause + a_peak + a_closure + a_priority + a_corridor AS tot FROM a1),
a3 AS (
  SELECT *, {exact_round_sql('b / 10.0::DOUBLE', 1, 'up')} AS c_val,
         CASE WHEN hi THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END AS p_mult,
         CASE WHEN cl THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS cl_mult,
         CASE WHEN pk THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS peak_mult,
         CASE WHEN co THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS corr_mult
  FROM a2
),
a4 AS (SELECT *, c_val * p_mult * cl_mult * peak_mult * corr_mult AS display_score FROM a3),
a5 AS (
  SELECT *, CASE WHEN display_score >= 7.0 THEN 'Critical' WHEN display_score >= 5.0 THEN 'High'
                 WHEN display_score >= 3.0 THEN 'Medium' ELSE 'Low' END AS display_severity
  FROM a4
)"""

BASE_ATTR = with_ctes(INC, FILLED, FB, ATTR)

TU = f"""
tu AS (
  SELECT false AS is_feedback, incident_id AS row_key, event_type, event_cause, police_station,
         hour, congestion_severity, 1.0::DOUBLE AS weight FROM train
  UNION ALL
  SELECT true, seq, coalesce(event_type, 'unplanned'), coalesce(event_cause, 'others'),
         coalesce(police_station, 'Unknown'), coalesce(hour, 12), actual_severity, 10.0::DOUBLE
  FROM fb WHERE actual_severity IS NOT NULL
)"""

BASE_TU = with_ctes(INC, FILLED, TRAIN, FB, TU)


TU2 = f"""
tu2 AS (
  SELECT false AS is_feedback, 'h-' || CAST(incident_id AS VARCHAR) AS row_key, event_type, event_cause,
         requires_road_closure, priority, corridor, police_station, hour, day_of_week, is_peak_hour,
         congestion_severity, 1.0::DOUBLE AS weight FROM train
  UNION ALL
  SELECT true, 'f-' || CAST(seq AS VARCHAR), coalesce(event_type, 'unplanned'), coalesce(event_cause, 'others'),
         coalesce(requires_road_closure, false), coalesce(priority, 'Low'), coalesce(corridor, 'Non-corridor'),
         coalesce(police_station, 'Unknown'), coalesce(hour, 12), coalesce(day_of_week, 1),
         CAST(coalesce(hour IN {PEAK}, false) AS INTEGER), actual_severity, 10.0::DOUBLE
  FROM fb WHERE actual_severity IS NOT NULL
),
vk AS (
  SELECT 'event_type' AS feature, coalesce(event_type, 'Unknown') AS value FROM tu2
  UNION SELECT 'event_cause', coalesce(event_cause, 'Unknown') FROM tu2
  UNION SELECT 'priority', coalesce(priority, 'Unknown') FROM tu2
  UNION SELECT 'corridor', coalesce(corridor, 'Unknown') FROM tu2
  UNION SELECT 'police_station', coalesce(police_station, 'Unknown') FROM tu2
  UNION SELECT f, 'Unknown' FROM (VALUES ('event_type'), ('event_cause'), ('priority'), ('corridor'),
                                         ('police_station')) v(f)
),
vocab AS (
  SELECT feature, value, CAST(row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS INTEGER) AS code
  FROM vk
)"""

BASE_VOCAB = with_ctes(INC, FILLED, TRAIN, FB, TU2)


def code_sql(tbl: str, col: str) -> str:
    return (f"coalesce((SELECT code FROM vocab WHERE feature = '{col}' AND value = coalesce({tbl}.{col}, 'Unknown')),"
            f" (SELECT code FROM vocab WHERE feature = '{col}' AND value = 'Unknown'), 0)")
