"""Keyword, band and code mappings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------------------------
COMPONENT_WORDS = [
    "airbag", "brake", "steering", "transmission", "engine", "fuel", "electrical", "suspension", "tire", "seatbelt",
    "accelerator",
]
DEFAULT_COMPONENT = "Safety System"

FAILURE_MODES = {
    "airbag": "Airbags failing to deploy during crashes or deploying unexpectedly during normal vehicle operation",
    "brake": "Brake system experiencing unexpected failure, loss of braking power, or reduced stopping capability",
    "steering": "Steering system losing responsiveness or experiencing sudden loss of control",
    "transmission": "Transmission slipping, jerking, or failing to properly engage gears",
    "engine": "Engine stalling, losing power, or failing during vehicle operation",
}
DEFAULT_FAILURE_MODE = "Component failure resulting in loss of vehicle control or safety system malfunction"

CONSEQUENCES = [
    (9, "Serious injuries, deaths, and significant property damage, posing an extreme danger to vehicle occupants "
        "and the public"),
    (7, "Significant injuries and property damage, creating substantial risk to vehicle occupants"),
    (5, "Potential for injury and property damage, representing a material safety concern"),
]
DEFAULT_CONSEQUENCE = "Risk of injury and property damage requiring attention"

CLASS_SIZES = [(1_000_000, "Millions"), (100_000, "Hundreds of thousands"), (10_000, "Tens of thousands")]
CLASS_SIZE_DEFAULT = "Thousands"
CLASS_SIZE_SUFFIX = " of vehicles nationwide"
VEHICLES_PER_COMPLAINT = 100

SUBSCRIPTION_STATUS = {
    "active": "ACTIVE",
    "trialing": "ACTIVE",
    "past_due": "PAST_DUE",
    "unpaid": "PAST_DUE",
    "canceled": "CANCELED",
    "incomplete": "INACTIVE",
    "incomplete_expired": "CANCELED",
    "paused": "INACTIVE",
}
PRICE_PLAN = {
    "price_basic_monthly": "BASIC",
    "price_basic_yearly": "BASIC",
    "price_pro_monthly": "PRO",
    "price_pro_yearly": "PRO",
    "price_enterprise_monthly": "ENTERPRISE",
    "price_enterprise_yearly": "ENTERPRISE",
}
PRICE_PLAN_WORDS = {"basic": "BASIC", "pro": "PRO", "enterprise": "ENTERPRISE"}
ORG_ROLE = {"org:admin": "ADMIN", "org:analyst": "ANALYST"}

ACTION_VERBS = {
    "CREATE": "created",
    "READ": "viewed",
    "UPDATE": "updated",
    "DELETE": "deleted",
    "LOGIN": "logged in",
    "LOGOUT": "logged out",
    "LOGIN_FAILED": "failed to log in",
    "EXPORT": "exported",
    "IMPORT": "imported",
    "PERMISSION_CHANGE": "changed permissions for",
}
SESSION_ACTIONS = ["LOGIN", "LOGOUT", "LOGIN_FAILED"]
# -------------------------------------------------------------------------------------------------------------------


def first_match(rules: list[tuple[Column, Column]], default) -> Column:
    """The value of the first rule that holds."""
    expr = None
    for condition, value in rules:
        expr = F.when(condition, value) if expr is None else expr.when(condition, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return default if expr is None else expr.otherwise(default)


def lookup(c: Column, table: dict[str, str], default) -> Column:
    return first_match([(c == key, F.lit(value)) for key, value in table.items()], default)


def component_keyword(name: Column) -> Column:
    low = F.lower(name)
    return first_match([(low.contains(w), F.lit(w.capitalize() + " System")) for w in COMPONENT_WORDS],
                       DEFAULT_COMPONENT)


def failure_mode(name: Column) -> Column:
    low = F.lower(name)
    return first_match([(low.contains(w), F.lit(text)) for w, text in FAILURE_MODES.items()], DEFAULT_FAILURE_MODE)


def consequence_band(severity: Column) -> Column:
    return first_match([(severity >= floor, F.lit(text)) for floor, text in CONSEQUENCES], DEFAULT_CONSEQUENCE)


def class_size_band(complaints: Column) -> Column:
    estimated = complaints * VEHICLES_PER_COMPLAINT
    return F.concat(first_match([(estimated >= floor, F.lit(text)) for floor, text in CLASS_SIZES],
                                CLASS_SIZE_DEFAULT), F.lit(CLASS_SIZE_SUFFIX))


def year_range(text: Column, as_of_year: int) -> tuple[Column, Column]:
    """(first, last) year of ``YYYY-YYYY``, of a single year, or the last three years when there is none."""
    pair = r"([0-9]{4})[ \t]*[-\x{2013}][ \t]*([0-9]{4})"
    text = F.coalesce(text, F.lit(""))
    single = F.regexp_extract(text, r"([0-9]{4})", 1)

    def pick(group: int, default: int) -> Column:
        return F.when(text.rlike(pair), F.regexp_extract(text, pair, group).try_cast("int")) \
            .when(single != "", single.try_cast("int")).otherwise(F.lit(default))

    return pick(1, as_of_year - 3), pick(2, as_of_year)


def format_year_range(first: Column, last: Column) -> Column:
    return F.when(first.isNotNull() & last.isNotNull(), F.concat(first.cast("string"), F.lit("-"), last.cast("string"))) \
        .when(first.isNotNull(), F.concat(first.cast("string"), F.lit("+"))).otherwise(F.lit(""))


def severity_band(severity: Column) -> Column:
    return F.when(severity >= 7, "high").when(severity >= 4, "medium").otherwise("low")


def severity_band_fine(severity: Column) -> Column:
    return F.when(severity >= 8, "critical").when(severity >= 5, "high").when(severity >= 3, "medium").otherwise("low")


def map_status(status: Column) -> Column:
    return lookup(status, SUBSCRIPTION_STATUS, "INACTIVE")


def map_price(price: Column) -> Column:
    exact = [(price == key, F.lit(plan)) for key, plan in PRICE_PLAN.items()]
    words = [(price.contains(word), F.lit(plan)) for word, plan in PRICE_PLAN_WORDS.items()]
    return first_match(exact + words, "FREE")


def map_role(role: Column) -> Column:
    return lookup(role, ORG_ROLE, "VIEWER")


def audit_line(user: Column, action: Column, resource: Column, resource_id: Column, at: Column) -> Column:
    verb = lookup(action, ACTION_VERBS, F.lower(action))
    stamp = F.concat(F.lit(" at "), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    head = F.concat(F.lit("User "), user, F.lit(" "), verb)
    target = F.concat(F.lit(" "), resource,
                      F.when(F.coalesce(resource_id, F.lit("")) != "", F.concat(F.lit(" ("), resource_id, F.lit(")")))
                      .otherwise(F.lit("")))
    return F.when(action.isin(*SESSION_ACTIONS), F.concat(head, stamp)).otherwise(F.concat(head, target, stamp))
