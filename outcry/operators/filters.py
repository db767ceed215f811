"""Filtered lists. A filter that is not given adds no predicate, so only real predicates reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outcry.functions.fields import ntz
from outcry.operators.paging import order_columns, paginate

# Fixed values.
LIST_COLUMNS = ["source_id", "make", "model", "model_year", "component", "description", "crash", "fire", "injuries",
                "deaths", "date_added"]
PATTERN_SORTS = ["severity_score", "trend_score", "complaint_count", "last_updated"]
PERMISSIONS = {
    "ANALYST": {
        "complaints": ["read", "search"],
        "patterns": ["read", "create", "update"],
        "generated_complaints": ["read", "create", "update", "delete"],
        "users": ["read"],
        "organizations": ["read"],
    },
    "VIEWER": {
        "complaints": ["read", "search"],
        "patterns": ["read"],
        "generated_complaints": ["read"],
        "users": [],
        "organizations": ["read"],
    },
}


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def holds(column: str, text: str) -> Column:
    return F.lower(F.col(column)).contains(text.lower())


def same(column: str, text: str) -> Column:
    return F.lower(F.col(column)) == text.lower()


def search_complaints(complaints: DataFrame, *, make: str | None = None, model: str | None = None,
                      component: str | None = None, year_from: int | None = None, year_to: int | None = None,
                      has_crash: bool = False, has_fire: bool = False, has_death: bool = False,
                      has_injury: bool = False, search: str | None = None) -> DataFrame:
    """Loose search: text filters match anywhere, flags only ever narrow."""
    where = [holds(c, t) for c, t in (("make", make), ("model", model), ("component", component)) if t]
    if year_from is not None:
        where.append(F.col("model_year") >= year_from)
    if year_to is not None:
        where.append(F.col("model_year") <= year_to)
    if has_crash:
        where.append(F.col("crash"))
    if has_fire:
        where.append(F.col("fire"))
    if has_death:
        where.append(F.col("deaths") > 0)
    if has_injury:
        where.append(F.col("injuries") > 0)
    if search:
        where.append(holds("description", search) | holds("component", search))
    return complaints.where(all_of(where)).select(*LIST_COLUMNS)


def filter_complaints(complaints: DataFrame, *, make: str | None = None, model: str | None = None,
                      component: str | None = None, year: int | None = None, year_from: int | None = None,
                      year_to: int | None = None, crash: bool | None = None, fire: bool | None = None,
                      injuries: bool | None = None, deaths: bool | None = None, since=None, until=None,
                      text: str | None = None) -> DataFrame:
    """Strict filter: make and model must be equal, a flag of ``False`` asks for rows without it, a year range
    replaces an exact year."""
    where = [same(c, t) for c, t in (("make", make), ("model", model)) if t]
    if component:
        where.append(holds("component", component))
    if year_from is not None or year_to is not None:
        if year_from is not None:
            where.append(F.col("model_year") >= year_from)
        if year_to is not None:
            where.append(F.col("model_year") <= year_to)
    elif year is not None:
        where.append(F.col("model_year") == year)
    where += [F.col(c) == flag for c, flag in (("crash", crash), ("fire", fire)) if flag is not None]
    where += [F.col(c) > 0 if flag else F.col(c) == 0 for c, flag in (("injuries", injuries), ("deaths", deaths))
              if flag is not None]
    if since is not None:
        where.append(F.col("date_added") >= ntz(since))
    if until is not None:
        where.append(F.col("date_added") <= ntz(until))
    if text:
        where.append(holds("description", text))
    return complaints.where(all_of(where))


def filter_patterns(patterns: DataFrame, *, make: str | None = None, model: str | None = None,
                    component: str | None = None, active: bool | None = None, org=..., min_severity: float | None = None,
                    min_trend: float | None = None, sort: str | None = None, way: str = "desc",
                    limit: int | None = None, pattern_key: str = "pattern_id") -> DataFrame:
    """Patterns by equality and thresholds. ``org=None`` asks for global patterns, leaving it out for all."""
    where = [same(c, t) for c, t in (("make", make), ("model", model)) if t]
    if component:
        where.append(holds("component", component))
    if active is not None:
        where.append(F.col("is_active") == active)
    if org is not ...:
        where.append(F.col("organization_id").eqNullSafe(F.lit(org)))
    if min_severity is not None:
        where.append(F.col("severity_score") >= min_severity)
    if min_trend is not None:
        where.append(F.col("trend_score") >= min_trend)
    out = patterns.where(all_of(where))
    field = sort if sort in PATTERN_SORTS else "severity_score"
    if limit is None and sort is None:
        return out
    out = out.orderBy(*order_columns([(field, way), (pattern_key, "asc")]))
    return out if limit is None else out.limit(limit)


SEVERE = "crash OR fire OR injuries > 0 OR deaths > 0"


def severe_complaints(complaints: DataFrame, make: str | None = None, model: str | None = None,
                      limit: int = 100) -> DataFrame:
    where = [F.expr(SEVERE)] + [same(c, t) for c, t in (("make", make), ("model", model)) if t]
    return (complaints.where(all_of(where))
            .orderBy(F.desc("deaths"), F.desc("injuries"), F.desc("crash"), "source_id", "date_added", "cluster_id")
            .limit(limit))


def filter_audit(events: DataFrame, org, *, org_col: str = "organization_id", user=None, action: str | None = None,
                 resource: str | None = None, since=None, until=None, page: int = 1, limit: int = 50) -> DataFrame:
    """One tenant's audit entries, newest first."""
    where = [F.col(org_col) == org]
    where += [F.col(c) == v for c, v in (("user_id", user), ("action", action), ("resource", resource)) if v is not None]
    if since is not None:
        where.append(F.col("created_at") >= ntz(since))
    if until is not None:
        where.append(F.col("created_at") <= ntz(until))
    return paginate(events.where(all_of(where)), [("created_at", "desc"), ("id", "desc")], page, limit)


def tenant_scope(df: DataFrame, org, include_global: bool = False, org_col: str = "organization_id") -> DataFrame:
    """Rows of one tenant, and global rows when asked."""
    own = F.col(org_col) == org
    return df.where(own | F.col(org_col).isNull() if include_global else own)


def search_patterns(patterns: DataFrame, min_severity: float | None = None, search: str | None = None,
                    defaults: DataFrame | None = None) -> DataFrame:
    """Patterns above a severity whose name, make or model holds the text; the same search over ``defaults`` when the
    tenant has no pattern at all."""
    where = []
    if min_severity is not None:
        where.append(F.col("severity_score") >= min_severity)
    if search:
        where.append(holds("name", search) | holds("make", search) | holds("model", search))
    found = patterns.where(all_of(where))
    if defaults is None:
        return found
    present = patterns.select(F.lit(1).alias("one")).limit(1)
    spare = (defaults.where(all_of(where)).withColumn("one", F.lit(1))
             .join(F.broadcast(present), "one", "left_anti").drop("one"))
    return found.unionByName(spare)


def permission_table(spark) -> DataFrame:
    rows = [(role, resource, action) for role, table in PERMISSIONS.items()
            for resource, actions in table.items() for action in actions]
    return spark.createDataFrame(rows, "role string, resource string, action string")


def access_violations(accesses: DataFrame) -> DataFrame:
    """Accesses (role, resource, action) that the role does not allow; administrators may do everything."""
    allowed = F.broadcast(permission_table(accesses.sparkSession))
    return (accesses.where(F.col("role") != "ADMIN")
            .join(allowed, ["role", "resource", "action"], "left_anti"))


def failed_logins(events: DataFrame, as_of, action: str = "LOGIN_FAILED", hours: int = 24) -> DataFrame:
    """Failed logins per user in the hours before ``as_of``."""
    start = ntz(as_of) - F.expr(f"interval {hours} hours")
    return (events.where((F.col("action") == action) & (F.col("created_at") >= start) & (F.col("created_at") <= ntz(as_of)))
            .groupBy("user_id").agg(F.count("*").alias("failed"), F.max("created_at").alias("last_failed_at")))


def user_actions(events: DataFrame, user, limit: int | None = None) -> DataFrame:
    out = events.where(F.col("user_id") == user).orderBy(F.desc("created_at"), F.desc("id"))
    return out if limit is None else out.limit(limit)


def resource_accesses(events: DataFrame, resource: str, resource_id) -> DataFrame:
    return events.where((F.col("resource") == resource) & (F.col("resource_id") == resource_id))
