"""Schemas and fixed values of the listings data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the original contract for equal results.
# ---------------------------------------------------------------------------
DEFAULT_MIN_LISTINGS = 10
DEFAULT_MAX_PRICE = 250000.0
DEFAULT_BROKER_ID = "22611.00"
DEFAULT_PERCENT_DELTA = 0.05
DEFAULT_LIMIT = 100
DEFAULT_POSTAL_CODE = "33993"
DEFAULT_BELOW_AVG_PCT = 0.10
DEFAULT_CITY = "Matlacha"
DEFAULT_MIN_BEDROOMS = 2
DEFAULT_MAX_SIZE_SQM = 150.0
DEFAULT_BATCH_SIZE = 20000

ACRE_TO_SQM = 4046.8564224
SQFT_TO_SQM = 0.09290304

# Allowed listing states (the enum of the relational layout).
STATUS_VALUES = ("for_sale", "ready_to_build", "sold")

# Text tokens treated as missing by the raw-CSV cleaner (after trim).
CLEANER_NULL_TOKENS = ("", "nan", "NaN", "None", "none", "NA", "NaT", "<NA>", "null")
# Text tokens treated as a missing date by the record parser (after trim).
PARSER_DATE_NULL_TOKENS = ("", "NaT", "nan", "None", "NaN")

# Valid year range of a parsed sale date, and the cleaner's cut (year <= 1970 dropped).
MIN_SOLD_YEAR = 1970
MAX_SOLD_YEAR = 2105
CLEANER_MIN_EXCLUSIVE_YEAR = 1970

# Mandatory fields of a listing record, in record order.
REQUIRED_FIELDS = (
    "brokered_by", "status", "price", "lot_size_sqm", "street", "city", "state", "zip_code",
)
# Keys the cleaner deduplicates on (first occurrence kept).
DEDUP_KEYS = ("brokered_by", "prev_sold_date", "price", "street", "city", "zip_code")

# Use-case display names of the run analysis, by contract number.
USECASE_LABELS = {
    1: "Filtering Query Properties",
    2: "Bulk Update",
    3: "Schema Evolution",
    4: "Analytical Query",
    5: "Aggregation",
    6: "Filtering Query Bedrooms and Size",
    7: "Bulk Import",
}

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
LISTING_COLUMNS = (
    "listing_id", "brokered_by", "status", "price", "lot_size_sqm", "street", "city", "state",
    "zip_code", "bed", "bath", "house_size_sqm", "prev_sold_date",
)

# Wide row-per-listing table.  Money and street ids are held as DOUBLE values
# rounded to cents so results exchange losslessly through Arrow/pandas; the
# relational layout keeps the same values.
LISTING = T.StructType([
    T.StructField("listing_id", T.LongType(), False),
    T.StructField("brokered_by", T.IntegerType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("price", T.DoubleType(), True),
    T.StructField("lot_size_sqm", T.DoubleType(), True),
    T.StructField("street", T.DoubleType(), True),
    T.StructField("city", T.StringType(), True),
    T.StructField("state", T.StringType(), True),
    T.StructField("zip_code", T.IntegerType(), True),
    T.StructField("bed", T.IntegerType(), True),
    T.StructField("bath", T.IntegerType(), True),
    T.StructField("house_size_sqm", T.DoubleType(), True),
    T.StructField("prev_sold_date", T.DateType(), True),
])

RAW_COLUMNS = (
    "brokered_by", "status", "price", "bed", "bath", "acre_lot", "street", "city", "state",
    "zip_code", "house_size", "prev_sold_date",
)
# Raw listing export: every column read as text.
RAW_LISTING = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])

CLEAN_CSV_COLUMNS = (
    "brokered_by", "status", "price", "bed", "bath", "lot_size_sqm", "street", "city", "state",
    "zip_code", "house_size_sqm", "prev_sold_date",
)
# Cleaned CSV as read by the record parser: text in, typed by expressions.
CLEAN_CSV = T.StructType([T.StructField(c, T.StringType(), True) for c in CLEAN_CSV_COLUMNS])

SAMPLE = T.StructType([
    T.StructField("timestamp", T.DoubleType(), True),
    T.StructField("cpu_percent", T.DoubleType(), True),
    T.StructField("mem_mb", T.DoubleType(), True),
    T.StructField("blkio_bytes", T.LongType(), True),
    T.StructField("net_rx_bytes", T.LongType(), True),
    T.StructField("net_tx_bytes", T.LongType(), True),
])

# One benchmark run record (one JSON object per line).
RUN = T.StructType([
    T.StructField("index", T.LongType(), True),
    T.StructField("run_id", T.StringType(), True),
    T.StructField("database", T.StringType(), True),
    T.StructField("container", T.StringType(), True),
    T.StructField("usecase", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("error", T.StringType(), True),
    T.StructField("execution_time_s", T.DoubleType(), True),
    T.StructField("execution_time_ms", T.LongType(), True),
    T.StructField("avg_cpu_percent", T.DoubleType(), True),
    T.StructField("peak_cpu_percent", T.DoubleType(), True),
    T.StructField("avg_mem_mb", T.DoubleType(), True),
    T.StructField("peak_mem_mb", T.DoubleType(), True),
    T.StructField("total_blkio_mb", T.DoubleType(), True),
    T.StructField("samples", T.LongType(), True),
    T.StructField("timestamp_utc", T.StringType(), True),
    T.StructField("raw_samples", T.ArrayType(SAMPLE), True),
])

# Container metric snapshot (the arithmetic inputs of CPU % and block I/O).
SNAPSHOT = T.StructType([
    T.StructField("ts", T.DoubleType(), True),
    T.StructField("cpu_total", T.LongType(), True),
    T.StructField("precpu_total", T.LongType(), True),
    T.StructField("system_cpu", T.LongType(), True),
    T.StructField("presystem_cpu", T.LongType(), True),
    T.StructField("online_cpus", T.IntegerType(), True),
    T.StructField("mem_usage", T.LongType(), True),
    T.StructField("blkio", T.ArrayType(T.StructType([T.StructField("value", T.LongType(), True)])), True),
])

# Nested document layout.
DOCUMENT = T.StructType([
    T.StructField("listing_id", T.LongType(), False),
    T.StructField("brokered_by", T.IntegerType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("price", T.DoubleType(), True),
    T.StructField("prev_sold_date", T.DateType(), True),
    T.StructField("estate_details", T.StructType([
        T.StructField("bed", T.IntegerType(), True),
        T.StructField("bath", T.IntegerType(), True),
        T.StructField("house_size", T.DoubleType(), True),
    ]), True),
    T.StructField("land_data", T.StructType([
        T.StructField("area_size_in_square_m", T.DoubleType(), True),
    ]), True),
    T.StructField("address", T.StructType([
        T.StructField("street", T.DoubleType(), True),
        T.StructField("zip_code", T.IntegerType(), True),
        T.StructField("city", T.StringType(), True),
        T.StructField("state", T.StringType(), True),
    ]), True),
])
