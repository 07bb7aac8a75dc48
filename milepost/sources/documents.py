"""Recorded API documents and log text -> typed tables.

The monitors in the source polled HTTP APIs and kept nothing. Here their
responses are rows (one JSON document per row) and every loader is a
``from_json`` + ``inline``/``explode`` projection, so documents are parsed
in parallel on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Money as reported: rounded once, after all sums.
AMOUNT = T.DecimalType(18, 2)
#: Money as recorded: nothing is rounded when documents are read.
RAW_AMOUNT = T.DecimalType(28, 10)
CENTS = RAW_AMOUNT

# The amounts that bills are known to hold; others are summed as otherAmount.
BILL_FIELDS = ["gpuCloudAmount", "cpuCloudAmount", "endpointAmount", "serverlessAmount", "storageAmount"]

BILLING_DOC = "data struct<myself struct<billing struct<summary array<map<string, string>>>>>"

ENDPOINT = T.StructType(
    [
        T.StructField("gpuIds", T.StringType()),
        T.StructField("gpuCount", T.IntegerType()),
        T.StructField("allowedCudaVersions", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("idleTimeout", T.IntegerType()),
        T.StructField("locations", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("networkVolumeId", T.StringType()),
        T.StructField("scalerType", T.StringType()),
        T.StructField("scalerValue", T.IntegerType()),
        T.StructField("templateId", T.StringType()),
        T.StructField("workersMax", T.IntegerType()),
        T.StructField("workersMin", T.IntegerType()),
        T.StructField("executionTimeoutMs", T.LongType()),
    ]
)
ENDPOINT_DOC = T.StructType(
    [
        T.StructField(
            "data",
            T.StructType(
                [T.StructField("myself", T.StructType([T.StructField("endpoints", T.ArrayType(ENDPOINT))]))]
            ),
        )
    ]
)

COST_DOC = f"costs: map<string, struct<total_cost_cents: {CENTS.simpleString()}>>"

PROBE_BODY = T.StructType(
    [T.StructField("res_jobs", T.ArrayType(T.StructType([T.StructField("error", T.StringType())])))]
)


# What became of a document.
OK, FAILED, MALFORMED, EMPTY = "ok", "failed", "malformed", "empty"
CORRUPT = "_corrupt_record"


def parse_documents(docs: DataFrame, schema: str, body: str = "body", content: str | None = None) -> DataFrame:
    """Recorded documents -> ``docs`` plus ``doc`` (parsed; NULL if it isn't
    whole), ``status`` and ``corrupt`` (the text of a malformed one).

    'failed': there is no body (the call failed); 'malformed': it isn't JSON of
    this shape; 'empty': the array or map named by ``content`` isn't there or has
    no entries; else 'ok'. One row per document, so nothing vanishes.
    """
    kind = f"struct<{schema}, {CORRUPT}: string>"
    doc = F.from_json(F.col(body), kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    parsed = docs.withColumn("doc", doc)
    corrupt = F.coalesce(F.col(f"doc.{CORRUPT}"), F.when(F.col("doc").isNull(), F.col(body)))
    status = F.when(F.col(body).isNull(), FAILED).when(corrupt.isNotNull(), MALFORMED)
    if content:
        status = status.when(F.coalesce(F.size(f"doc.{content}"), F.lit(0)) <= 0, EMPTY)
    whole = F.when(corrupt.isNull(), F.col("doc").dropFields(CORRUPT))
    return parsed.withColumns({"doc": whole, "status": status.otherwise(OK), "corrupt": corrupt})


def document_problems(parsed: DataFrame, *keys: str) -> DataFrame:
    """(keys, status, documents, example) of the documents that hold nothing."""
    bad = parsed.filter(F.col("status") != OK)
    return bad.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("documents"), F.min("corrupt").alias("example"))


def load_billing(
    docs: DataFrame, body: str = "body", keep: tuple = ("provider",), position: str | None = None
) -> DataFrame:
    """Billing summaries -> one row per daily record.

    ``time`` is ISO-8601 text with ``Z``; amounts are decimals (never
    doubles, so sums are exact) with all recorded places. Keys that end in
    ``Amount`` but aren't in BILL_FIELDS are summed as ``otherAmount``; a
    value that is no number counts as missing. ``position`` names a column
    for a record's place in its document.
    """
    parsed = docs.select(*keep, F.from_json(body, BILLING_DOC)["data"]["myself"]["billing"]["summary"].alias("_s"))
    rows = parsed.select(*keep, F.posexplode("_s").alias("_position", "_r"))
    others = F.map_filter("_r", lambda k, v: k.endswith("Amount") & ~k.isin(BILL_FIELDS))
    zero = F.lit(0).cast(RAW_AMOUNT)
    other = F.aggregate(
        F.map_values(others), zero, lambda total, v: (total + F.coalesce(v.try_cast(RAW_AMOUNT), zero)).cast(RAW_AMOUNT)
    )
    return rows.select(
        *keep,
        *([F.col("_position").alias(position)] if position else []),
        F.to_timestamp(F.col("_r")["time"]).alias("time"),
        *[F.col("_r")[f].try_cast(RAW_AMOUNT).alias(f) for f in BILL_FIELDS],
        other.alias("otherAmount"),
    )


def cost_documents(docs: DataFrame, body: str = "body") -> DataFrame:
    """App cost documents, parsed: ``docs`` plus doc, status and corrupt."""
    return parse_documents(docs, COST_DOC, body, "costs")


def load_app_costs(docs: DataFrame, body: str = "body", keep: tuple = ("app", "project")) -> DataFrame:
    """Cost documents keyed by day text -> (app, project, day, cents). Documents
    without costs have no rows here; :func:`cost_documents` tells why."""
    rows = cost_documents(docs, body).select(*keep, F.explode("doc.costs").alias("day", "_c"))
    return rows.select(*keep, "day", F.col("_c.total_cost_cents").alias("cents"))


def load_endpoints(docs: DataFrame, body: str = "body", keep: tuple = ("snapshot_id",)) -> DataFrame:
    """Endpoint inventories -> one row per endpoint (14 fields).

    A key missing from a record and an explicit ``null`` both load as NULL.
    """
    parsed = docs.select(*keep, F.from_json(body, ENDPOINT_DOC).alias("_d"))
    return parsed.select(*keep, F.inline(F.col("_d.data.myself.endpoints")))


def load_probes(probes: DataFrame, body: str = "body") -> DataFrame:
    """Recorded probe responses -> the same rows with the body parsed into
    ``res_jobs`` (NULL when the body is missing or not JSON)."""
    return probes.withColumn("res_jobs", F.from_json(F.col(body), PROBE_BODY)["res_jobs"])


def parse_target_list(docs: DataFrame, col: str = "targets") -> DataFrame:
    """JSON arrays of endpoint names -> one row per name (``name``).

    A malformed list is fatal, as in the source (FAILFAST raises at run time).
    """
    arr = F.from_json(F.col(col), T.ArrayType(T.StringType()), {"mode": "FAILFAST"})
    return docs.select(F.explode(arr).alias("name")).filter(F.col("name").isNotNull())


# The log line layout "%(asctime)s - %(name)s - %(levelname)s - %(message)s"
# with datefmt "%Y-%m-%d %H:%M:%S".
LOG_PATTERN = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d) - (.*?) - ([A-Z]+) - (.*)$"


def parse_logs(lines: DataFrame, col: str = "value") -> DataFrame:
    """Log text lines -> (ts, logger, level, message); other lines dropped.

    The logger name is matched non-greedily, so a message may itself
    contain ' - '.
    """
    v = F.col(col)
    out = lines.select(
        F.try_to_timestamp(F.regexp_extract(v, LOG_PATTERN, 1), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"),
        F.regexp_extract(v, LOG_PATTERN, 2).alias("logger"),
        F.regexp_extract(v, LOG_PATTERN, 3).alias("level"),
        F.regexp_extract(v, LOG_PATTERN, 4).alias("message"),
    )
    return out.filter(F.col("ts").isNotNull())


def scan_logs(spark, path: str) -> DataFrame:
    """Read log files (text, one record per line) and parse them."""
    return parse_logs(spark.read.text(path))
