"""Triage requests over the event table, and fixed models whose answers SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hazardflow import dims
from hazardflow.checks.fixtures import hazard_events, with_views
from hazardflow.checks.registry import query, r6, sql_round
from hazardflow.checks.rows import CHANNEL_SQL, GEO, SQL_FEATURES, _clip
from hazardflow.operators import enrich, models
from hazardflow.operators.boosting import Trees
from hazardflow.operators.sequence_training import SequenceModel
from hazardflow.plans import triage

TWO_DAYS = 172_800
# Every so many-th event is no request but empties all held answers.
CLEAR_EVERY = 1500
_MAGNITUDE, _VULNERABILITY = (dims.MODEL_FEATURES.index(n) for n in ("magnitude_or_wind_speed", "infrastructure_vulnerability_score"))
_CUTS, _CUT = [0.175, 0.4, 0.75], 0.6
# By class: start, the gain in each magnitude range, and the gains below and above the vulnerability cut.
_GAINS = {
    "EXTREME": (-2.0, [-1.0, -0.5, 0.25, 2.0], [0.0, 0.5]),
    "MINOR": (-0.5, [2.0, 0.5, -0.5, -1.0], [0.25, 0.0]),
    "MODERATE": (-1.0, [0.5, 1.5, 0.25, -0.5], [0.125, 0.0]),
    "SEVERE": (-1.5, [-0.5, 0.25, 1.75, 0.5], [0.0, 0.375]),
}
_SLOPES, _OFFSETS = {1: 0.5, 3: 1.0, 6: 1.5}, {1: -2.0, 3: -1.0, 6: -0.5}


def fixed_severity() -> Trees:
    """Two rounds: one cuts the magnitude score into four ranges, the other the vulnerability into two."""
    edges: list[list[float]] = [[] for _ in dims.MODEL_FEATURES]
    edges[_MAGNITUDE], edges[_VULNERABILITY] = _CUTS, [_CUT]
    rounds = [([_MAGNITUDE] * 3, [1, 0, 2]), ([_VULNERABILITY, -1, -1], [0, 0, 0])]
    value = [[_GAINS[c][1] for c in models.CLASSES], [[low, 0.0, high, 0.0] for low, high in (_GAINS[c][2] for c in models.CLASSES)]]
    n = len(models.CLASSES)
    return Trees(
        list(dims.MODEL_FEATURES), models.CLASSES, edges, [_GAINS[c][0] for c in models.CLASSES], 2,
        [f for f, _ in rounds for _ in range(n)], [b for _, b in rounds for _ in range(n)], [v for r in value for v in r],
        [0.75 if i == _MAGNITUDE else 0.25 if i == _VULNERABILITY else 0.0 for i in range(len(dims.MODEL_FEATURES))],
    )


def fixed_escalation() -> SequenceModel:
    """A logistic unit on the first reading of the newest step."""
    size, at = models.SEQUENCE_VALUES, (dims.SEQUENCE_STEPS - 1) * dims.SEQUENCE_WIDTH
    weights = [[slope if i == at else 0.0 for i in range(size)] for slope in _SLOPES.values()]
    return SequenceModel(list(_SLOPES), [0.0] * size, [1.0] * size, weights, list(_OFFSETS.values()))


_CENTRES = {"latitude": [0, 36, 28, 42, 31, 61, -33, 45], "longitude": [-80, -119, -83, -75, -99, -150, 151, -100]}
_PLACES = {
    name: f"CASE sensor_id % 8 {' '.join(f'WHEN {i} THEN CAST({v} AS DOUBLE)' for i, v in enumerate(values))} END"
    for name, values in _CENTRES.items()
}
_STEPPED = "CAST(floor(value / CAST(40 AS DOUBLE)) * 40 AS DOUBLE)"


def as_requests(events: DataFrame) -> DataFrame:
    """Events as requests with coarse magnitudes and places, so that answers repeat; a fourth lacks its sequence."""
    steps = F.array_repeat(F.array(F.col("value") / 50, *[F.lit(0.0)] * (dims.SEQUENCE_WIDTH - 1)), dims.SEQUENCE_STEPS)
    return events.withColumns(
        {
            **{name: F.expr(text) for name, text in _PLACES.items()},
            "magnitude": F.expr(_STEPPED),
            "sensor_sequence": F.when(F.col("seq") % 4 != 0, steps),
            "additional_features": F.create_map().cast("map<string,double>"),
            "_local_ts": F.col("ts"),
            "is_clear": F.col("seq") % CLEAR_EVERY == 1,
        }
    )


def answer_rows(answers: DataFrame) -> DataFrame:
    """Responses as the SQL below has them."""
    return answers.select(
        "event_id",
        "severity",
        r6("confidence").alias("confidence"),
        "escalation_likely",
        r6("escalation_probability_3h").alias("escalation_probability_3h"),
        F.array_join("recommended_channels", ",").alias("channels"),
        "affected_population_estimate",
        "risk_score",
    )


def _margin(c: str) -> str:
    start, ranges, (low, high) = _GAINS[c]
    cuts = " ".join(f"WHEN mag <= {cut} THEN {gain}" for cut, gain in zip(_CUTS, ranges))
    return f"({start}::DOUBLE + CASE {cuts} ELSE {ranges[-1]} END + CASE WHEN vul <= {_CUT} THEN {low} ELSE {high} END)"


_LIMITS = {name: (low, high, default) for name, low, high, _, default in dims.INPUT_LIMITS}
_KEYS = {
    "k1": _clip("m", *_LIMITS["magnitude_or_wind_speed"]),
    "k2": _clip("population_density", *_LIMITS["population_density_at_center"]),
    "k3": _clip("vulnerability_score", *_LIMITS["infrastructure_vulnerability_score"]),
}
_BY_CLASS = {c: f"x_{c.lower()}" for c in models.CLASSES}
_TOP = f"greatest({', '.join(_BY_CLASS.values())})"
_REQUESTS = f"""requests AS (SELECT * REPLACE ({_STEPPED} AS magnitude, {', '.join(f'{t} AS {n}' for n, t in _PLACES.items())})
    FROM hazard_events),
  {GEO.strip().replace('FROM hazard_events', 'FROM requests')}"""
_SCORED = f"""felt AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in _KEYS.items())},
    {SQL_FEATURES['magnitude_or_wind_speed']} AS mag, {SQL_FEATURES['infrastructure_vulnerability_score']} AS vul FROM geo),
  margins AS (SELECT *, {', '.join(f'{_margin(c)} AS {x}' for c, x in _BY_CLASS.items())},
    1 / (1 + exp(-({_SLOPES[3]} * CASE WHEN seq % 4 = 0 THEN 0 ELSE value / 50 END + {_OFFSETS[3]}))) AS p3 FROM felt),
  scored AS (SELECT *, CASE {' '.join(f"WHEN {x} = {_TOP} THEN '{c}'" for c, x in _BY_CLASS.items())} END AS label,
    exp({_TOP}) / ({' + '.join(f'exp({x})' for x in _BY_CLASS.values())}) AS sure FROM margins)"""


def answers_sql(seconds: int, clears: bool) -> str:
    """All responses, with answers held for ``seconds`` by processed inputs, and emptied by clearing events if wanted."""
    epoch = (
        f"coalesce(max(CASE WHEN seq % {CLEAR_EVERY} = 1 THEN epoch_us(ts) END) OVER (ORDER BY ts RANGE UNBOUNDED PRECEDING), -1)"
        if clears
        else "0"
    )
    asked = f"WHERE seq % {CLEAR_EVERY} <> 1" if clears else ""
    same = " AND ".join(f"o.{c} = f.{c}" for c in ("k1", "k2", "k3", "epoch"))
    limit = f"CAST({seconds} AS BIGINT) * 1000000"
    return with_views(
        f"""{_REQUESTS}, {_SCORED},
        timed AS (SELECT *, {epoch} AS epoch FROM scored),
        o AS (SELECT event_id, k1, k2, k3, epoch, epoch_us(ts) AS t,
          ROW_NUMBER() OVER (PARTITION BY k1, k2, k3, epoch ORDER BY ts, event_id) AS rn FROM timed {asked}),
        f AS (SELECT *, t AS put, event_id AS src FROM o WHERE rn = 1
          UNION ALL
          SELECT o.*, CASE WHEN o.t - f.put <= {limit} THEN f.put ELSE o.t END,
            CASE WHEN o.t - f.put <= {limit} THEN f.src ELSE o.event_id END
          FROM f JOIN o ON {same} AND o.rn = f.rn + 1)
        SELECT f.event_id, s.label AS severity, {sql_round('s.sure')} AS confidence, s.p3 >= 0.65::DOUBLE AS escalation_likely,
          {sql_round('s.p3')} AS escalation_probability_3h, {CHANNEL_SQL.format(s='s.label')} AS channels,
          own.estimated_affected_population AS affected_population_estimate, own.composite_risk_score AS risk_score
        FROM f JOIN scored s ON s.event_id = f.src JOIN scored own ON own.event_id = f.event_id""",
        "hazard_events",
        recursive=True,
    )


@query("triage_response", answers_sql(TWO_DAYS, clears=False))
def triage_response(spark: SparkSession, sf: str) -> DataFrame:
    """Requests through the whole job as tables: risk, features, quality, held answers, both models, responses."""
    answers, _ = triage.triage(
        as_requests(hazard_events(spark, sf)), fixed_severity(), fixed_escalation(), "_local_ts",
        extra="additional_features", sequence="sensor_sequence", reuse_seconds=TWO_DAYS,
    )
    return answer_rows(answers)


FLAGSHIP_SQL = with_views(
    f"""{GEO}, {_SCORED}, daily AS (SELECT strftime(ts, '%Y-%m-%d') AS day, label AS severity,
      COUNT(*) AS notifications, AVG(composite_risk_score) AS r, SUM(estimated_affected_population) AS p,
      COUNT(*) FILTER (WHERE magnitude IS NULL) AS w FROM scored GROUP BY 1, 2)
    SELECT day, severity, unnest(string_split({CHANNEL_SQL.format(s='severity')}, ',')) AS channel, notifications,
      {sql_round('r')} AS mean_risk, CAST(p AS BIGINT) AS affected_population, w AS with_warnings FROM daily""",
    "hazard_events",
)


@query("routing_load", FLAGSHIP_SQL)
def routing_load(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: events through geography, features, quality and the severity model to daily load per severity and channel.

    The raw magnitude is passed on unfilled here, so that missing ones show as quality warnings.
    """
    located = enrich.feature_vector(enrich.geo_risk(hazard_events(spark, sf)))
    values = {**enrich.raw_inputs(), "magnitude_or_wind_speed": F.col("magnitude")}
    valid, _ = enrich.quality_checked(located, values, enrich.given_inputs())
    load = triage.routing_load(triage.predicted(valid, fixed_severity(), None, None))
    return load.select(
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        "severity",
        "channel",
        "notifications",
        r6("mean_risk").alias("mean_risk"),
        "affected_population",
        "with_warnings",
    )
