"""Row-level queries: features, geography, quality, routing, requests and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hazardflow import dims
from hazardflow.checks.fixtures import hazard_events, table, view, with_views
from hazardflow.checks.registry import query, r6, sql_round, sql_stamp, stamp
from hazardflow.functions import decisions, features, geo, quality
from hazardflow.operators import enrich
from hazardflow.operators.evaluation import split_name
from hazardflow.plans import triage
from hazardflow.sources import requests, sinks

# --- SQL fragments -------------------------------------------------------------------------------------

_CODES = " ".join(f"WHEN contains(k, '{w}') THEN {i}" for i, w in enumerate(dims.EVENT_TYPES))
_NIBBLES = "list_transform(string_split({h}, ''), lambda x: instr('0123456789abcdef', x) - 1)"


def sql_type_code(text: str) -> str:
    key = f"regexp_replace(lower({text}), '^\\s+|\\s+$', '', 'g')"
    cases = _CODES.replace("contains(k,", f"contains({key},")
    return f"(CASE {cases} ELSE list_sum({_NIBBLES.format(h=f'md5({key})')}) % 15 END) / 15.0::DOUBLE"


_HAS = "contains(lower(event_type), '{}')"
SQL_FEATURES = {
    "event_type_encoded": sql_type_code("event_type"),
    "magnitude_or_wind_speed": f"least(CASE WHEN {_HAS.format('earthquake')} THEN m / 10 ELSE m / 200 END, 1)",
    "population_density_at_center": "least(population_density / 20000, 1)",
    "infrastructure_vulnerability_score": "vulnerability_score",
    "prior_24h_event_count": "least(prior_24h_event_count / 10.0::DOUBLE, 1)",
    "network_degradation_index": (
        f"CASE WHEN {_HAS.format('earthquake')} OR {_HAS.format('tsunami')} OR {_HAS.format('hurricane')} "
        "THEN least(least(m / 8, 1) * 1.4::DOUBLE, 1) ELSE least(m / 8, 1) * 0.7::DOUBLE END"
    ),
    "time_of_day_risk_factor": (
        "CASE WHEN hour(ts) >= 22 OR hour(ts) < 6 THEN 0.9::DOUBLE "
        "WHEN hour(ts) IN (6, 7, 8, 17, 18, 19) THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END"
    ),
    "evacuation_route_availability": "greatest(0.1::DOUBLE, 1 - abs((latitude % 3 + 3) % 3) / 3)",
    "hospital_proximity_score": "greatest(0.1::DOUBLE, 1 - (abs(latitude) % 5) / 5)",
    "weather_compounding_factor": (
        f"CASE WHEN {_HAS.format('wildfire')} OR {_HAS.format('hurricane')} "
        "THEN least(0.3::DOUBLE + m / 15, 1) ELSE 0.2::DOUBLE END"
    ),
}

GEO = """
geo0 AS (
  SELECT *, CASE WHEN abs(latitude) < 5 AND abs(longitude + 80) < 20 THEN 'coastal'
      WHEN latitude > 30 AND latitude < 50 AND longitude > -120 AND longitude < -70 THEN 'urban_high_density'
      ELSE 'suburban' END AS region_type,
    greatest(500::DOUBLE, 5000::DOUBLE * abs(sin(latitude)) * abs(cos(longitude))) AS population_density,
    coalesce(magnitude, 0::DOUBLE) AS m
  FROM hazard_events),
geo1 AS (
  SELECT *, CASE region_type WHEN 'coastal' THEN 0.85::DOUBLE WHEN 'urban_high_density' THEN 0.72::DOUBLE
      ELSE 0.55::DOUBLE END AS vulnerability_score,
    least(1::DOUBLE, 1 / (1 + 0.1::DOUBLE * abs(longitude + 80))) AS coastal_factor
  FROM geo0),
geo AS (
  SELECT *, CAST(trunc(population_density * pi() * 625 * 0.3::DOUBLE) AS BIGINT) AS estimated_affected_population,
    floor((0.4::DOUBLE * vulnerability_score + 0.3::DOUBLE * least(population_density / 10000, 1)
      + 0.3::DOUBLE * coastal_factor) * 10000 + 0.5) / 10000 AS composite_risk_score,
    floor((abs((latitude % 5 + 5) % 5) * 2.5::DOUBLE + 1.2::DOUBLE) * 10 + 0.5) / 10 AS nearest_shelter_km,
    CAST(greatest(1, trunc(abs(latitude) % 8) + 2) AS BIGINT) AS hospital_count_25km
  FROM geo1)
"""

CHANNEL_SQL = "CASE {s} " + " ".join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in dims.CHANNELS.items()) + " END"


def _clip(column: str, low: float, high: float, default: float) -> str:
    value = f"coalesce({column}, {default}::DOUBLE)"
    return f"(greatest({low}::DOUBLE, least({high}::DOUBLE, {value})) - ({low}::DOUBLE)) / ({high - low}::DOUBLE)"


# --- features ------------------------------------------------------------------------------------------


@query(
    "event_type_code",
    with_views(
        f"""SELECT event_id, {sql_round(sql_type_code('event_type'))} AS code,
        {sql_round(sql_type_code("concat(' ', event_type, ' ', source, '  ')"))} AS padded_code,
        {sql_round(sql_type_code("concat('k', event_id)"))} AS fallback_code FROM hazard_events""",
        "hazard_events",
    ),
)
def event_type_code(spark: SparkSession, sf: str) -> DataFrame:
    padded = F.concat(F.lit(" "), "event_type", F.lit(" "), "source", F.lit("  "))
    return hazard_events(spark, sf).select(
        "event_id",
        r6(features.event_type_code(F.col("event_type"))).alias("code"),
        r6(features.event_type_code(padded)).alias("padded_code"),
        r6(features.event_type_code(F.concat(F.lit("k"), "event_id"))).alias("fallback_code"),
    )


@query(
    "event_type_code_texts",
    f"SELECT doc_id, {sql_round(sql_type_code('text'))} AS code FROM documents",
)
def event_type_code_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The code of whole free texts, where hazard words occur anywhere or not at all."""
    documents = table(spark, sf, "documents")
    lowered = documents.select("doc_id", "text", F.lower("text").alias("lower"))
    return lowered.select("doc_id", r6(features.event_type_code(F.col("text"), F.col("lower"))).alias("code"))


_SHA = _NIBBLES.format(h="sha256(t)")
_BUCKET = f"(16 * (list_sum({_SHA}) - ({_SHA})[-1]) + ({_SHA})[-1]) % 20"


@query(
    "event_type_bucket",
    f"SELECT event_id, CAST({_BUCKET} AS BIGINT) AS bucket "
    "FROM (SELECT event_id, concat(event_type, '/', CAST(user_id AS VARCHAR)) AS t FROM events)",
)
def event_type_bucket(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat("event_type", F.lit("/"), F.col("user_id").cast("string"))
    events = table(spark, sf, "events")
    return events.select("event_id", features.event_type_bucket(text).cast("bigint").alias("bucket"))


_FEATURE_SELECT = ", ".join(f"{sql_round(e)} AS {n}" for n, e in SQL_FEATURES.items())


@query("feature_vector", with_views(f"{GEO} SELECT event_id, {_FEATURE_SELECT} FROM geo", "hazard_events"))
def feature_vector(spark: SparkSession, sf: str) -> DataFrame:
    rows = enrich.feature_vector(enrich.geo_risk(hazard_events(spark, sf)))
    return rows.select("event_id", *[r6(n).alias(n) for n in dims.MODEL_FEATURES])


def _single_feature(name: str, feature: str) -> None:
    sql = with_views(f"{GEO} SELECT event_id, {sql_round(SQL_FEATURES[feature])} AS score FROM geo", "hazard_events")

    @query(name, sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = enrich.geo_risk(hazard_events(spark, sf))
        column = features.model_features(
            F.col("event_type"),
            F.col("magnitude"),
            F.col("latitude"),
            F.col("longitude"),
            F.col("ts"),
            F.col("prior_24h_event_count"),
            F.col("population_density"),
            F.col("vulnerability_score"),
        )[feature]
        return rows.select("event_id", r6(column).alias("score"))


for _name, _feature in {
    "magnitude_score": "magnitude_or_wind_speed",
    "density_score": "population_density_at_center",
    "prior_count_score": "prior_24h_event_count",
    "network_degradation": "network_degradation_index",
    "time_of_day_risk": "time_of_day_risk_factor",
    "evacuation_score": "evacuation_route_availability",
    "hospital_score": "hospital_proximity_score",
    "weather_compounding": "weather_compounding_factor",
}.items():
    _single_feature(_name, _feature)


_WORDS = "CASE seq % 7 WHEN 0 THEN 'Extreme' WHEN 1 THEN 'Severe' WHEN 2 THEN 'Moderate' WHEN 3 THEN 'Minor' WHEN 4 THEN 'Unknown' WHEN 5 THEN 'extreme' ELSE 'Other' END"


@query(
    "cap_severity",
    with_views(
        f"""SELECT event_id, word, CASE word WHEN 'Extreme' THEN 'EXTREME' WHEN 'Severe' THEN 'SEVERE'
        WHEN 'Moderate' THEN 'MODERATE' WHEN 'Minor' THEN 'MINOR' WHEN 'Unknown' THEN 'MINOR' END AS severity
        FROM (SELECT event_id, {_WORDS} AS word FROM hazard_events)""",
        "hazard_events",
    ),
)
def cap_severity(spark: SparkSession, sf: str) -> DataFrame:
    rows = hazard_events(spark, sf).select("event_id", F.expr(_WORDS).alias("word"))
    return rows.withColumn("severity", decisions.cap_severity(F.col("word")))


# --- geography -----------------------------------------------------------------------------------------

_GEO_COLUMNS = [
    "region_type",
    "vulnerability_score",
    "estimated_affected_population",
    "composite_risk_score",
    "nearest_shelter_km",
    "hospital_count_25km",
]


@query(
    "geo_risk",
    with_views(
        f"{GEO} SELECT event_id, {sql_round('population_density')} AS population_density, "
        f"{sql_round('coastal_factor')} AS coastal_factor, {', '.join(_GEO_COLUMNS)} FROM geo",
        "hazard_events",
    ),
)
def geo_risk(spark: SparkSession, sf: str) -> DataFrame:
    rows = enrich.geo_risk(hazard_events(spark, sf))
    return rows.select(
        "event_id",
        r6("population_density").alias("population_density"),
        r6(geo.coastal_proximity(F.col("longitude"))).alias("coastal_factor"),
        *_GEO_COLUMNS,
    )


@query(
    "region_summary",
    with_views(
        f"""{GEO} SELECT region_type, COUNT(*) AS events, MIN(hospital_count_25km) AS min_hospitals,
        MAX(nearest_shelter_km) AS max_shelter_km, {sql_round('AVG(composite_risk_score)')} AS mean_risk
        FROM geo GROUP BY region_type""",
        "hazard_events",
    ),
)
def region_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = enrich.geo_risk(hazard_events(spark, sf))
    return rows.groupBy("region_type").agg(
        F.count(F.lit(1)).alias("events"),
        F.min("hospital_count_25km").alias("min_hospitals"),
        F.max("nearest_shelter_km").alias("max_shelter_km"),
        r6(F.avg("composite_risk_score")).alias("mean_risk"),
    )


STATE = """CASE WHEN latitude > 32.5 AND latitude < 42 AND longitude > -124.5 AND longitude < -114 THEN 'CA'
  WHEN latitude > 25 AND latitude < 31 AND longitude > -88 AND longitude < -80 THEN 'FL'
  WHEN latitude > 40 AND latitude < 45 AND longitude > -80 AND longitude < -72 THEN 'NY'
  WHEN latitude > 25.8 AND latitude < 36.5 AND longitude > -106.6 AND longitude < -93.5 THEN 'TX' ELSE 'US' END"""


@query("state_inference", with_views(f"SELECT event_id, {STATE} AS state FROM hazard_events", "hazard_events"))
def state_inference(spark: SparkSession, sf: str) -> DataFrame:
    rows = hazard_events(spark, sf)
    return rows.select("event_id", geo.infer_state(F.col("latitude"), F.col("longitude")).alias("state"))


_DENSITIES = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in dims.STATE_DENSITY.items())


@query(
    "population_estimate",
    with_views(
        f"""density(state_code, base) AS (VALUES {_DENSITIES}),
    named AS (SELECT event_id, affected_area_sq_km AS area, coalesce(state_code, {STATE}) AS state
      FROM hazard_events),
    joined AS (SELECT n.*, d.base IS NOT NULL AS known, coalesce(d.base, 25::DOUBLE) AS base
      FROM named n LEFT JOIN density d ON n.state = d.state_code),
    urban AS (SELECT *, CASE WHEN base > 200 THEN 0.9::DOUBLE WHEN base > 100 THEN 0.7::DOUBLE
      WHEN base > 50 THEN 0.5::DOUBLE WHEN base > 20 THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS uf FROM joined)
    SELECT event_id, state AS inferred_state, uf AS urban_fraction,
      {sql_round('base * (1::DOUBLE + 2::DOUBLE * uf)')} AS density_per_sq_km,
      CAST(trunc(base * (1::DOUBLE + 2::DOUBLE * uf) * area) AS BIGINT) AS estimated_population,
      CASE WHEN known AND area < 1000 THEN 'HIGH' WHEN known THEN 'MEDIUM' ELSE 'LOW' END AS population_confidence
    FROM urban""",
        "hazard_events",
    ),
)
def population_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.population(hazard_events(spark, sf)).select(
        "event_id",
        "inferred_state",
        "urban_fraction",
        r6("density_per_sq_km").alias("density_per_sq_km"),
        "estimated_population",
        "population_confidence",
    )


# Polygon texts of every shape: boxes, blanks, broken numbers and wrong pair sizes.
_POLYGON_TEXT = """CASE c_custkey % 6
  WHEN 0 THEN CONCAT(CAST(c_custkey AS VARCHAR(12)), '.5,-', CAST(c_nationkey AS VARCHAR(12)), ' 1,2  3,4')
  WHEN 1 THEN '   ' WHEN 2 THEN CONCAT('1,2 x,', CAST(c_custkey AS VARCHAR(12)))
  WHEN 3 THEN '1,2,3 4,5,6' WHEN 4 THEN CONCAT(' -7.25,', CAST(c_custkey AS VARCHAR(12)), ' ')
  ELSE CONCAT('0,0 0,', CAST(c_custkey AS VARCHAR(12)), ' 5,5 0,0') END"""


@query(
    "cap_polygon_parse",
    f"""WITH t AS (SELECT c_custkey AS id, {_POLYGON_TEXT} AS txt FROM customer),
    p AS (SELECT id, unnest(regexp_split_to_array(trim(txt), '\\s+')) AS pair FROM t WHERE trim(txt) <> ''),
    n AS (SELECT id, len(string_split(pair, ',')) = 2 AS two,
      TRY_CAST(string_split(pair, ',')[1] AS DOUBLE) AS lat, TRY_CAST(string_split(pair, ',')[2] AS DOUBLE) AS lon
      FROM p),
    g AS (SELECT id, COUNT(*) AS points, bool_and(two AND lat IS NOT NULL AND lon IS NOT NULL) AS ok,
      SUM(lat) AS slat, SUM(lon) AS slon FROM n GROUP BY id)
    SELECT CAST(t.id AS BIGINT) AS id, coalesce(g.ok, TRUE) AS polygon_ok,
      CASE WHEN g.ok THEN CAST(points AS BIGINT) END AS points,
      CASE WHEN g.ok THEN {sql_round('slat')} END AS lat_sum, CASE WHEN g.ok THEN {sql_round('slon')} END AS lon_sum
    FROM t LEFT JOIN g ON t.id = g.id""",
)
def cap_polygon_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("bigint").alias("id"), geo.parse_polygon(F.expr(_POLYGON_TEXT)).alias("polygon")
    )
    ok = geo.polygon_ok(F.col("polygon"))
    good = ok & F.col("polygon").isNotNull()

    def total(field: str):
        return r6(F.aggregate("polygon", F.lit(0.0), lambda acc, p: acc + p[field]))

    return rows.select(
        "id",
        ok.alias("polygon_ok"),
        F.when(good, F.size("polygon").cast("bigint")).alias("points"),
        F.when(good, total("lat")).alias("lat_sum"),
        F.when(good, total("lon")).alias("lon_sum"),
    )


# --- input quality -------------------------------------------------------------------------------------

_REQUIRED = [n for n, _, _, required, _ in dims.INPUT_LIMITS if required]
_NUMBERS = ", ".join(f"TRY_CAST({n} AS DOUBLE) AS n_{n}" for n in dims.INPUT_NAMES)


def _sql_errors(strict: bool) -> str:
    found = []
    for name, _, _, required, _ in dims.INPUT_LIMITS:
        found.append(f"CASE WHEN {name} IS NOT NULL AND n_{name} IS NULL THEN '{name}: not numeric' END")
        found.append(f"CASE WHEN isnan(n_{name}) THEN '{name}: NaN' END")
        if strict and required:
            found.append(f"CASE WHEN {name} IS NULL THEN '{name}: missing' END")
    return f"concat_ws('|', {', '.join(found)})"


_SQL_WARNINGS = f"concat_ws('|', {', '.join(f'''CASE WHEN {n} IS NULL THEN '{n}: missing' END''' for n in _REQUIRED)})"
_NUMERIC = f"numeric_inputs AS (SELECT *, {_NUMBERS} FROM raw_inputs)"
_SQL_PROCESSED = {n: _clip(f"n_{n}", low, high, d) for n, low, high, _, d in dims.INPUT_LIMITS}


def _inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, dict]:
    return view(spark, sf, "raw_inputs"), {n: F.col(n) for n in dims.INPUT_NAMES}


def _mapped_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, dict]:
    """The same inputs as a map without its missing entries, as requests bring them."""
    entries = [part for n in dims.INPUT_NAMES for part in (F.lit(n), F.col(n))]
    raw = F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())
    return view(spark, sf, "raw_inputs").select("event_id", raw.alias("raw")), quality.from_map(F.col("raw"))


@query(
    "input_validation",
    with_views(
        f"""{_NUMERIC} SELECT event_id, {_sql_errors(False)} AS errors, {_sql_errors(True)} AS strict_errors,
        {_SQL_WARNINGS} AS warnings FROM numeric_inputs""",
        "raw_inputs",
    ),
)
def input_validation(spark: SparkSession, sf: str) -> DataFrame:
    rows, values = _mapped_inputs(spark, sf)
    return rows.select(
        "event_id",
        F.array_join(quality.errors(values), "|").alias("errors"),
        F.array_join(quality.errors(values, strict=True), "|").alias("strict_errors"),
        F.array_join(quality.warnings(values), "|").alias("warnings"),
    )


_IMPUTED = ", ".join(
    f"{sql_round(f'coalesce(n_{n}, {d}::DOUBLE)')} AS {n}" for n, _, _, _, d in dims.INPUT_LIMITS
)


@query(
    "input_imputation",
    with_views(
        f"{_NUMERIC} SELECT event_id, {_IMPUTED} FROM numeric_inputs WHERE {_sql_errors(False)} = ''", "raw_inputs"
    ),
)
def input_imputation(spark: SparkSession, sf: str) -> DataFrame:
    rows, values = _inputs(spark, sf)
    valid = rows.where(quality.is_valid(values))
    return valid.select("event_id", *[r6(c).alias(n) for n, c in quality.impute(values).items()])


_CLIPPED = ", ".join(
    sql_round(f"greatest({low}::DOUBLE, least({high}::DOUBLE, coalesce(n_{n}, {d}::DOUBLE)))") + f" AS {n}"
    for n, low, high, _, d in dims.INPUT_LIMITS
)


@query(
    "input_clipping",
    with_views(
        f"{_NUMERIC} SELECT event_id, {_CLIPPED} FROM numeric_inputs WHERE {_sql_errors(False)} = ''", "raw_inputs"
    ),
)
def input_clipping(spark: SparkSession, sf: str) -> DataFrame:
    rows, values = _inputs(spark, sf)
    valid = rows.where(quality.is_valid(values))
    clipped = quality.preprocess(values, quality.Scaling.NONE)
    return valid.select("event_id", *[r6(c).alias(n) for n, c in clipped.items()])


_PROCESSED = ", ".join(f"{sql_round(e)} AS {n}" for n, e in _SQL_PROCESSED.items())


@query(
    "input_preprocessing",
    with_views(
        f"{_NUMERIC} SELECT event_id, {_PROCESSED} FROM numeric_inputs WHERE {_sql_errors(False)} = ''", "raw_inputs"
    ),
)
def input_preprocessing(spark: SparkSession, sf: str) -> DataFrame:
    rows, values = _inputs(spark, sf)
    valid, _ = enrich.quality_checked(rows, values)
    return valid.select("event_id", *[r6(f"in_{n}").alias(n) for n in dims.INPUT_NAMES])


@query(
    "input_quarantine",
    with_views(
        f"""{_NUMERIC}, reasons AS (SELECT unnest(string_split({_sql_errors(True)}, '|')) AS reason
        FROM numeric_inputs WHERE {_sql_errors(True)} <> '')
        SELECT reason, COUNT(*) AS n FROM reasons GROUP BY reason""",
        "raw_inputs",
    ),
)
def input_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    rows, values = _inputs(spark, sf)
    _, bad = enrich.quality_checked(rows, values, strict=True)
    reasons = bad.select(F.explode("quality_errors").alias("reason"))
    return reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fitted_scaling",
    with_views(
        f"""s AS (SELECT AVG(value) AS a, stddev_samp(value) AS d, quantile_cont(latency_ms, 0.5) AS q2,
          quantile_cont(latency_ms, 0.75) - quantile_cont(latency_ms, 0.25) AS iqr FROM hazard_events)
        SELECT event_id, {sql_round('(value - a) / d')} AS z_value,
          {sql_round('(latency_ms - q2) / iqr')} AS robust_latency FROM hazard_events, s""",
        "hazard_events",
    ),
)
def fitted_scaling(spark: SparkSession, sf: str) -> DataFrame:
    rows = hazard_events(spark, sf).select("event_id", "value", "latency_ms")
    z = enrich.fit_scaling(rows, ["value"], quality.Scaling.Z_SCORE)
    both = enrich.fit_scaling(z, ["latency_ms"], quality.Scaling.ROBUST)
    return both.select("event_id", r6("value").alias("z_value"), r6("latency_ms").alias("robust_latency"))


@query(
    "feature_key_groups",
    with_views(
        f"""{GEO}, g AS (SELECT COUNT(*) AS n FROM geo GROUP BY {', '.join(SQL_FEATURES.values())})
        SELECT n AS group_size, COUNT(*) AS groups FROM g GROUP BY n""",
        "hazard_events",
    ),
)
def feature_key_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = enrich.feature_vector(enrich.geo_risk(hazard_events(spark, sf)))
    keyed = rows.groupBy(decisions.feature_key(dims.MODEL_FEATURES).alias("key")).agg(
        F.count(F.lit(1)).alias("group_size")
    )
    return keyed.groupBy("group_size").agg(F.count(F.lit(1)).alias("groups"))


@query(
    "input_key_groups",
    with_views(
        f"""{_NUMERIC}, g AS (SELECT COUNT(*) AS n FROM numeric_inputs WHERE {_sql_errors(False)} = ''
        GROUP BY {', '.join(_SQL_PROCESSED.values())}) SELECT n AS group_size, COUNT(*) AS groups FROM g GROUP BY n""",
        "raw_inputs",
    ),
)
def input_key_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The key over the ten processed inputs."""
    rows, values = _inputs(spark, sf)
    valid, _ = enrich.quality_checked(rows, values)
    key = decisions.feature_key([f"in_{n}" for n in dims.INPUT_NAMES])
    keyed = valid.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("group_size"))
    return keyed.groupBy("group_size").agg(F.count(F.lit(1)).alias("groups"))


@query(
    "severity_lookup",
    with_views(
        f"""SELECT event_id, predicted_severity AS severity, severity_rank AS observed_rank,
        CASE predicted_severity WHEN 'EXTREME' THEN 4 WHEN 'SEVERE' THEN 3 WHEN 'MODERATE' THEN 2 ELSE 1 END
          AS severity_rank, {CHANNEL_SQL.format(s='predicted_severity')} AS channels FROM hazard_events""",
        "hazard_events",
    ),
)
def severity_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The lookup as a join with the four-row severity table."""
    rows = hazard_events(spark, sf).select(
        "event_id", F.col("predicted_severity").alias("severity"), F.col("severity_rank").alias("observed_rank")
    )
    joined = rows.join(F.broadcast(dims.severity_dim(spark)), "severity", "left")
    return joined.withColumn("channels", F.array_join("channels", ","))


# --- decisions -----------------------------------------------------------------------------------------


@query(
    "channel_routing",
    with_views(
        f"SELECT event_id, predicted_severity, {CHANNEL_SQL.format(s='predicted_severity')} AS channels "
        "FROM hazard_events",
        "hazard_events",
    ),
)
def channel_routing(spark: SparkSession, sf: str) -> DataFrame:
    rows = hazard_events(spark, sf)
    return rows.select(
        "event_id", "predicted_severity", F.array_join(decisions.channels(F.col("predicted_severity")), ",").alias("channels")
    )


@query(
    "channel_load",
    with_views(
        f"""c AS (SELECT unnest(string_split({CHANNEL_SQL.format(s='observed_severity')}, ',')) AS channel
        FROM hazard_events) SELECT channel, COUNT(*) AS messages FROM c GROUP BY channel""",
        "hazard_events",
    ),
)
def channel_load(spark: SparkSession, sf: str) -> DataFrame:
    return triage.channel_load(hazard_events(spark, sf), "observed_severity")


# Stand-in probabilities from the event value.
_P = {"p1h": "1 - 1 / (1 + value / 200)", "p3h": "1 - 1 / (1 + value / 50)", "p6h": "1 - 1 / (1 + value / 20)"}
_P_COLUMNS = ", ".join(f"{e} AS {n}" for n, e in _P.items())


@query(
    "escalation_decision",
    with_views(
        f"""SELECT event_id, p3h >= 0.65::DOUBLE AS escalation_likely,
        {sql_round('(p1h + p3h + p6h) / 3::DOUBLE')} AS confidence
        FROM (SELECT event_id, {_P_COLUMNS} FROM hazard_events)""",
        "hazard_events",
    ),
)
def escalation_decision(spark: SparkSession, sf: str) -> DataFrame:
    rows = hazard_events(spark, sf).select("event_id", *[F.expr(e).alias(n) for n, e in _P.items()])
    return rows.select(
        "event_id",
        decisions.escalation_likely(F.col("p3h")).alias("escalation_likely"),
        r6(decisions.escalation_confidence(F.col("p1h"), F.col("p3h"), F.col("p6h"))).alias("confidence"),
    )


# Stand-in class probabilities with many ties, in class order.
_Q = ["seq % 5", "seq % 3 + 1", "seq % 4", "sensor_id % 4"]
_QUARTERS = [f"CAST({e} AS DOUBLE) / 8" for e in _Q]


@query(
    "argmax_label",
    with_views(
        f"""p AS (SELECT event_id, [{', '.join(_QUARTERS)}] AS p FROM hazard_events)
        SELECT event_id, CASE WHEN p[1] >= p[2] AND p[1] >= p[3] AND p[1] >= p[4] THEN 'EXTREME'
          WHEN p[2] >= p[3] AND p[2] >= p[4] THEN 'MINOR' WHEN p[3] >= p[4] THEN 'MODERATE' ELSE 'SEVERE' END
          AS severity, list_max(p) AS confidence FROM p""",
        "hazard_events",
    ),
)
def argmax_label(spark: SparkSession, sf: str) -> DataFrame:
    rows = hazard_events(spark, sf).select("event_id", F.array(*[F.expr(q) for q in _QUARTERS]).alias("p"))
    label = decisions.argmax_label(F.col("p"), sorted(dims.SEVERITIES))
    return rows.select("event_id", label.alias("severity"), F.array_max("p").alias("confidence"))


@query(
    "untrained_severity",
    with_views(
        f"""{GEO} SELECT event_id, 'MODERATE' AS severity, 0::DOUBLE AS confidence,
        'alert_platform,push,telegram' AS channels, FALSE AS escalation_likely,
        estimated_affected_population AS affected_population_estimate, composite_risk_score AS risk_score FROM geo""",
        "hazard_events",
    ),
)
def untrained_severity(spark: SparkSession, sf: str) -> DataFrame:
    """The whole triage job without a model."""
    answers, _ = triage.triage(hazard_events(spark, sf), None)
    return answers.select(
        "event_id",
        "severity",
        "confidence",
        F.array_join("recommended_channels", ",").alias("channels"),
        "escalation_likely",
        "affected_population_estimate",
        "risk_score",
    )


# Sequences of 24 x 15, too short ones, narrow ones and none.
_LENGTH = "CASE seq % 4 WHEN 0 THEN 24 WHEN 1 THEN 23 ELSE 24 END"
_WIDTH = "CASE seq % 4 WHEN 2 THEN 14 ELSE 15 END"


@query(
    "sequence_validity",
    with_views(
        f"""SELECT event_id, seq % 8 <> 7 AND {_LENGTH} = 24 AND {_WIDTH} = 15 AS valid,
        CASE WHEN seq % 8 <> 7 AND {_LENGTH} = 24 AND {_WIDTH} = 15 THEN {sql_round('value * 360')} ELSE 0::DOUBLE END
        AS total, CAST(24 AS BIGINT) AS steps FROM hazard_events""",
        "hazard_events",
    ),
)
def sequence_validity(spark: SparkSession, sf: str) -> DataFrame:
    sequence = F.when(
        F.expr("seq % 8 <> 7"), F.array_repeat(F.array_repeat("value", F.expr(_WIDTH)), F.expr(_LENGTH))
    )
    rows = hazard_events(spark, sf).select("event_id", sequence.alias("s"))
    # One check of the shape per row, used three times.
    checked = rows.select("event_id", "s", decisions.sequence_valid(F.col("s")).alias("valid"))
    used = decisions.sequence_or_zeros(F.col("s"), F.col("valid"))
    total = F.aggregate(F.flatten(used), F.lit(0.0), lambda acc, x: acc + x)
    return checked.select(
        "event_id",
        "valid",
        r6(total).alias("total"),
        F.size(used).cast("bigint").alias("steps"),
    )


# --- requests and messages -----------------------------------------------------------------------------

_BAD_LAT = "CASE WHEN seq % 20 = 0 THEN latitude * 100 ELSE latitude END"


def request_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Requests as JSON texts: valid ones, broken ones, wrong types, missing and out-of-range fields."""
    rows = hazard_events(spark, sf)
    body = F.struct(
        "event_id",
        F.when(F.expr("seq % 33 <> 0"), F.col("event_type")).alias("event_type"),
        F.expr(_BAD_LAT).alias("latitude"),
        (F.col("longitude") * F.when(F.expr("seq % 21 = 0"), 2.0).otherwise(1.0)).alias("longitude"),
        "magnitude",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.create_map(F.lit("affected_area_sq_km"), F.col("affected_area_sq_km")).alias("additional_features"),
    )
    text = F.to_json(body)
    wrong = F.regexp_replace(text, r'"latitude":[-0-9.E]+', '"latitude":"north"')
    value = F.when(F.expr("seq % 97 = 0"), F.lit("{broken")).when(F.expr("seq % 89 = 0"), wrong).otherwise(text)
    return rows.select("seq", value.alias("value"))


_PROBLEMS = f"""CASE WHEN seq % 97 = 0
  THEN 'malformed record|event_id missing|event_type missing|latitude missing|longitude missing'
  ELSE concat_ws('|', CASE WHEN seq % 89 = 0 THEN 'malformed record' END,
    CASE WHEN seq % 33 = 0 THEN 'event_type missing' END, CASE WHEN seq % 89 = 0 THEN 'latitude missing' END,
    CASE WHEN seq % 89 <> 0 AND abs({_BAD_LAT}) > 90 THEN 'latitude out of range' END,
    CASE WHEN abs(CASE WHEN seq % 21 = 0 THEN longitude * 2 ELSE longitude END) > 180
      THEN 'longitude out of range' END) END"""


@query(
    "request_validation",
    with_views(
        f"""SELECT seq, {_PROBLEMS} AS problems,
        CASE WHEN seq % 97 = 0 THEN 0::DOUBLE ELSE {sql_round('coalesce(magnitude, 0)')} END AS magnitude,
        CASE WHEN seq % 97 <> 0 THEN {sql_round('affected_area_sq_km')} END AS area,
        CASE WHEN seq % 97 = 0 THEN '2000-01-01 00:00:00' ELSE {sql_stamp('ts')} END AS ts FROM hazard_events""",
        "hazard_events",
    ),
)
def request_validation(spark: SparkSession, sf: str) -> DataFrame:
    from hazardflow import schemas

    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = request_messages(spark, sf).select(
        "seq", F.from_json("value", schemas.REQUEST, options).alias("r")
    ).select("seq", "r.*")
    checked = requests.checked_requests(parsed, F.lit("2000-01-01 00:00:00").cast("timestamp"))
    return checked.select(
        "seq",
        F.array_join("problems", "|").alias("problems"),
        r6("magnitude").alias("magnitude"),
        r6(F.try_element_at("additional_features", F.lit("affected_area_sq_km"))).alias("area"),
        stamp("ts").alias("ts"),
    )


@query(
    "keyed_messages",
    with_views(
        f"""{GEO} SELECT event_id AS key, event_id, observed_severity AS severity,
        {sql_round('composite_risk_score')} AS risk_score, region_type,
        CAST(estimated_affected_population AS BIGINT) AS people FROM geo""",
        "hazard_events",
    ),
)
def keyed_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages as written, read back from their JSON value."""
    results = enrich.geo_risk(hazard_events(spark, sf)).select(
        "event_id",
        F.col("observed_severity").alias("severity"),
        F.col("composite_risk_score").alias("risk_score"),
        "region_type",
        F.col("estimated_affected_population").alias("people"),
    )
    schema = "event_id string, severity string, risk_score double, region_type string, people bigint"
    messages = sinks.keyed_messages(results)
    parsed = messages.select("key", F.from_json("value", schema).alias("v")).select("key", "v.*")
    return parsed.withColumn("risk_score", r6("risk_score"))


@query(
    "replayable_split",
    with_views(
        """SELECT split, COUNT(*) AS n, CAST(SUM(seq) AS BIGINT) AS id_sum FROM (
        SELECT seq, CASE WHEN CAST(concat('0x', substr(md5(event_id), 1, 8)) AS BIGINT) % 5 = 0 THEN 'test'
          ELSE 'train' END AS split FROM hazard_events) GROUP BY split""",
        "hazard_events",
    ),
)
def replayable_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = hazard_events(spark, sf).select("seq", split_name(F.col("event_id")).alias("split"))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("id_sum"))
