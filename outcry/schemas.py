"""Table schemas and fixed code values."""

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
_TS = T.TimestampNTZType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


# Flat bulk feed: every field arrives as text.
RAW_BULK_FIELDS = [
    "cmplid", "odino", "mfr_name", "maketxt", "modeltxt", "yeartxt", "crash", "fire", "injured", "deaths",
    "compdesc", "cdescr", "faildate", "datea", "ldate", "vin", "miles", "city", "state", "cmpl_type",
    "prod_type", "medical_attn", "vehicles_towed_yn",
]
RAW_BULK = T.StructType([T.StructField(name, _S) for name in RAW_BULK_FIELDS])

# Nested per-vehicle feed.
RAW_API_RECORD = _struct(
    odiNumber=_S, manufacturer=_S, crash=_S, fire=_S, numberOfInjured=_I, numberOfDeaths=_I, dateOfIncident=_S,
    dateComplaintFiled=_S, vin=_S, components=_S, summary=_S,
    products=T.ArrayType(_struct(type=_S, manufacturer=_S, make=_S, model=_S, year=_I)),
)
RAW_API = _struct(count=_I, message=_S, results=T.ArrayType(RAW_API_RECORD))

# Clean complaint fact, as the cleaning jobs emit it.
COMPLAINT = _struct(
    source_id=_S, odi_number=_S, manufacturer=_S, make=_S, model=_S, model_year=_I, component=_S, description=_S,
    crash=_B, fire=_B, injuries=_I, deaths=_I, fail_date=_TS, date_added=_TS,
)

PATTERN = _struct(
    pattern_id=_S, name=_S, make=_S, model=_S, component=_S, complaint_count=_L, crash_count=_L, fire_count=_L,
    injury_count=_L, death_count=_L, severity_score=_D, trend_score=_D, trend_direction=_S, is_active=_B,
    organization_id=_S, first_seen=_TS, last_updated=_TS,
)

EVENTS = T.StructType([
    T.StructField("event_id", _L), T.StructField("ts", _TS), T.StructField("user_id", _L),
    T.StructField("event_type", _S), T.StructField("value", _D), T.StructField("props", _S),
])

# Fixed code values.
PLANS = ["FREE", "BASIC", "PRO", "ENTERPRISE"]
ROLES = ["ADMIN", "ANALYST", "VIEWER"]
DOCUMENT_STATES = ["DRAFT", "FINALIZED", "FILED"]
SUBSCRIPTION_STATES = ["ACTIVE", "INACTIVE", "PAST_DUE", "CANCELED"]
TRENDS = ["INCREASING", "DECREASING", "STABLE"]
