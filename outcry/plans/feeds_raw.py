"""Raw feeds rendered from the complaint rows, bad rows included, and landed as files for the readers.

Landed text says the same field names and phrases in every record, so the files are packed with gzip. Such a file is read by one
task; files hold FILE_ROWS records at most, so that a large feed comes in many. They are packed at level three, in half the time
of the default level and a fifth larger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from outcry.schemas import RAW_BULK_FIELDS
from outcry.session import scratch_path
from outcry.plans.views import table

# (field, Spark SQL, DuckDB SQL); one text when both read it alike.
_DAY = ("date_format(l_shipdate, 'yyyyMMdd')", "strftime(l_shipdate, '%Y%m%d')")
_FAIL = ("date_format(l_shipdate - interval 10 days, 'yyyyMMdd')", "strftime(l_shipdate - INTERVAL 10 DAY, '%Y%m%d')")
_CASES = {
    "cmplid": "concat(cast(l_orderkey as string), '-', cast(l_linenumber as string))",
    "odino": "CASE WHEN l_orderkey > 100 THEN cast(l_orderkey as string) END",
    "mfr_name": "concat('  ', p_brand, '   Motor \t Company ')",
    "maketxt": "concat(lower(p_brand), ' ')",
    "modeltxt": "p_type",
    "yeartxt": "CASE WHEN p_size = 50 THEN '9999' WHEN p_size = 49 THEN 'n/a' ELSE cast(1970 + p_size as string) END",
    "crash": "CASE WHEN l_returnflag = 'R' THEN 'Y' WHEN l_returnflag = 'A' THEN ' yes ' ELSE 'N' END",
    "fire": "CASE WHEN l_linestatus = 'F' AND l_discount >= 0.09 THEN 'Y' END",
    "injured": "CASE WHEN l_quantity >= 45 THEN concat(cast(cast(l_quantity as int) - 44 as string), 'abc') "
               "WHEN l_quantity < 3 THEN '' ELSE '0' END",
    "deaths": "CASE WHEN l_quantity >= 50 THEN '1' WHEN l_quantity < 5 THEN 'x' ELSE '0' END",
    "compdesc": "CASE WHEN p_size = 1 THEN ':none' WHEN p_size = 2 THEN NULL ELSE concat(p_name, ' :', p_type) END",
    "cdescr": "concat(' The  ', p_name, '\r\n of  my ', p_brand, CASE WHEN p_size = 3 THEN '' ELSE ' failed ' END)",
    "faildate": ("CASE WHEN l_linestatus = 'F' THEN {} ELSE '' END", _FAIL),
    "datea": ("CASE WHEN l_tax >= 0.08 THEN '2023' WHEN l_tax >= 0.07 THEN '20231345' ELSE {} END", _DAY),
    "city": "l_linestatus",
    "state": "p_brand",
}


def _text(field: str, engine: int) -> str:
    case = _CASES[field]
    return case if isinstance(case, str) else case[0].format(case[1][engine])


def _joined(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with their part. Where parts are too many to broadcast, lines are hashed rather than sorted, which would spill them.
    The lines of a part come one after the other within a task, as most of a record's text is its part's and packs the better."""
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "part").hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.sortWithinPartitions("l_partkey")


def raw_bulk(spark: SparkSession, sf: str) -> DataFrame:
    joined = _joined(spark, sf)
    return joined.select(*[(F.expr(_text(f, 0)) if f in _CASES else F.lit(None).cast("string")).alias(f)
                           for f in RAW_BULK_FIELDS])


#: Records of a landed file; some 100 MB of text.
FILE_ROWS = 250_000


def packed(writer: DataFrameWriter) -> DataFrameWriter:
    return writer.options(compression="gzip", maxRecordsPerFile=FILE_ROWS).option("zlib.compress.level", "THREE")


RAW_BULK_SQL = "raw_bulk AS (SELECT " + ", ".join(
    f"{_text(f, 1)} AS {f}" for f in _CASES) + " FROM lineitem JOIN part ON l_partkey = p_partkey)"

_API_DATE = ("CASE WHEN l_tax >= 0.08 THEN 'soon' WHEN l_tax >= 0.07 THEN '' WHEN l_tax >= 0.04 THEN {} ELSE {} END",
             ("date_format(l_shipdate, 'MM/dd/yyyy')", "date_format(l_shipdate, 'yyyy-MM-dd')"),
             ("strftime(l_shipdate, '%m/%d/%Y')", "strftime(l_shipdate, '%Y-%m-%d')"))


def raw_api(spark: SparkSession, sf: str) -> DataFrame:
    """One response per complaint, shaped like the per-vehicle feed."""
    joined = _joined(spark, sf)
    record = F.struct(
        F.expr(_text("cmplid", 0)).alias("odiNumber"), F.expr(_text("mfr_name", 0)).alias("manufacturer"),
        F.expr("CASE WHEN l_returnflag = 'R' THEN 'Yes' ELSE 'No' END").alias("crash"), F.lit("No").alias("fire"),
        F.expr("cast(l_linenumber as int)").alias("numberOfInjured"), F.lit(None).cast("int").alias("numberOfDeaths"),
        F.expr("CASE WHEN l_linestatus = 'F' THEN date_format(l_shipdate, 'yyyy-MM-dd') ELSE '' END").alias("dateOfIncident"),
        F.expr(_API_DATE[0].format(*_API_DATE[1])).alias("dateComplaintFiled"), F.lit(None).cast("string").alias("vin"),
        F.expr(_text("compdesc", 0)).alias("components"), F.expr(_text("cdescr", 0)).alias("summary"),
        F.expr("""CASE WHEN p_size = 4 THEN array() ELSE array(named_struct('type', 'VEHICLE', 'manufacturer', p_brand,
                  'make', lower(p_brand), 'model', p_type, 'year', cast(1970 + p_size as int))) END""").alias("products"))
    return joined.select(F.lit(1).alias("count"), F.lit("Results returned").alias("message"), F.array(record).alias("results"))


RAW_API_SQL = f"""raw_api AS (SELECT {_text('cmplid', 1)} AS odi, {_text('compdesc', 1)} AS components,
  {_text('cdescr', 1)} AS summary, CASE WHEN l_returnflag = 'R' THEN 'Yes' ELSE 'No' END AS crash,
  CAST(l_linenumber AS INT) AS injured, CASE WHEN l_linestatus = 'F' THEN strftime(l_shipdate, '%Y-%m-%d') ELSE '' END AS incident,
  {_API_DATE[0].format(*_API_DATE[2])} AS filed, CASE WHEN p_size <> 4 THEN p_brand END AS make, p_type AS model,
  1970 + p_size AS year FROM lineitem JOIN part ON l_partkey = p_partkey)"""

_LANDED: dict[tuple[str, str, str], str] = {}


def land(spark: SparkSession, sf: str, kind: str) -> str:
    """Write a raw feed to files once per session and return the folder."""
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _LANDED:
        path = scratch_path(spark, f"landed-{kind}")
        if kind == "json":
            packed(raw_bulk(spark, sf).write).json(path)
        elif kind == "csv":
            # One line per record, as the history file has it.
            flat = raw_bulk(spark, sf).withColumn("cdescr", F.regexp_replace("cdescr", "[\r\n]+", " ")) \
                .withColumn("mfr_name", F.regexp_replace("mfr_name", "\t", " "))
            packed(flat.write).options(sep="\t", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
        elif kind == "pages":
            packed(raw_bulk(spark, sf).write).partitionBy("city").json(path)
        else:
            packed(raw_api(spark, sf).write).json(path)
        _LANDED[key] = path
    return _LANDED[key]
