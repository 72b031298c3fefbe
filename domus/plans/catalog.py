"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query reads the given tables (or frames Spark derives from them) in
full, so its work grows with the data.  Parameters are fixed per query and
chosen so that filters and HAVING clauses bite at every scale factor.
Floating averages are rounded to 4 decimals for an engine-independent
comparison with the SQL oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domus.functions.measures import adjust_price, price_per_sqm, round_half_up
from domus.functions.text import null_if_token, title_case
from domus.operators import cleaning as cl
from domus.operators import documents as doc
from domus.operators import mutate as mu
from domus.operators import quality as qa
from domus.operators import star as st
from domus.operators import telemetry as tm
from domus.operators import usecases as uc
from domus.operators.joins import first_per_group, null_safe_match
from domus.plans import sql as sq
from domus.schema import CLEANER_NULL_TOKENS, DEDUP_KEYS, LISTING_COLUMNS
from domus.session import materialize, scratch_path
from domus.sources.derived import clean_csv_text, raw_listings_text
from domus.sources.runs import runs_from_events, samples_from_events, snapshots_from_events
from domus.sources.tables import listings_from_tables, table
from domus.streaming import ingest as st_ingest
from domus.streaming import telemetry as st_tele

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings_from_tables(spark, sf_dir)


# ---------------------------------------------------------------- use cases
@register("listings")
def q_listings(spark, sf_dir):
    return _l(spark, sf_dir)


@register("uc1_filter_properties")
def q_uc1(spark, sf_dir):
    return uc.uc1_filter_properties(_l(spark, sf_dir), min_listings=500, max_price=250000.0)


@register("cities_with_min_listings")
def q_cities_min(spark, sf_dir):
    return uc.cities_with_min_listings(_l(spark, sf_dir), 500)


@register("uc2_update_prices")
def q_uc2(spark, sf_dir):
    return uc.uc2_update_prices(_l(spark, sf_dir), broker_id="605.00", percent_delta=0.05, limit=10)


@register("uc3_solar_panels")
def q_uc3(spark, sf_dir):
    return uc.uc3_add_solar_panels(_l(spark, sf_dir))


@register("uc4_below_threshold")
def q_uc4a(spark, sf_dir):
    return uc.uc4_below_threshold(_l(spark, sf_dir), postal_code="10500", below_avg_pct=0.10)


@register("uc4_sorted_by_city")
def q_uc4b(spark, sf_dir):
    return uc.uc4_sorted_by_city(_l(spark, sf_dir), city=" Nation_7 ")


@register("uc5_avg_price_per_city")
def q_uc5(spark, sf_dir):
    return uc.uc5_avg_price_per_city(_l(spark, sf_dir)) \
        .withColumn("avg_price_per_sqm", round_half_up("avg_price_per_sqm", 4))


@register("uc6_bedrooms_size")
def q_uc6(spark, sf_dir):
    return uc.uc6_filter_by_bedrooms_and_size(_l(spark, sf_dir), min_bedrooms=2, max_size=150.0)


@register("avg_if")
def q_avg_if(spark, sf_dir):
    return uc.avg_if(_l(spark, sf_dir), min_price=100000.0) \
        .withColumn("avg_price_per_sqm", round_half_up("avg_price_per_sqm", 4))


@register("price_per_sqm")
def q_ppsqm(spark, sf_dir):
    return _l(spark, sf_dir).select("listing_id", price_per_sqm().alias("price_per_sqm"))


@register("top_n_per_broker")
def q_topn(spark, sf_dir):
    return uc.top_n_per_broker(_l(spark, sf_dir), 3)


@register("top_n_per_broker_ranked")
def q_topn_ranked(spark, sf_dir):
    return uc.top_n_per_broker(_l(spark, sf_dir), 3, method="range")


@register("total_count")
def q_total(spark, sf_dir):
    return _l(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- text exports, cleaning, parsing


@register("title_case")
def q_title(spark, sf_dir):
    raw = raw_listings_text(spark, sf_dir)
    return raw.select("src_pos", title_case("city").alias("city_title"), title_case("state").alias("state_title"))


@register("null_tokens")
def q_tokens(spark, sf_dir):
    raw = raw_listings_text(spark, sf_dir)
    return raw.select("src_pos", *[null_if_token(c, CLEANER_NULL_TOKENS).alias(c)
                                   for c in ("status", "city", "state", "prev_sold_date")])


@register("unit_conversion")
def q_units(spark, sf_dir):
    return cl.convert_units(raw_listings_text(spark, sf_dir)).select("src_pos", "lot_size_sqm", "house_size_sqm")


@register("clean_listings")
def q_clean(spark, sf_dir):
    return cl.clean_raw(raw_listings_text(spark, sf_dir))


@register("clean_listings_narrow")
def q_clean_narrow(spark, sf_dir):
    """the money and area columns in float32, duplicates found on the narrowed values."""
    return cl.clean_raw(raw_listings_text(spark, sf_dir), narrow=True)


@register("cleaned_csv_rows")
def q_clean_csv(spark, sf_dir):
    return cl.format_clean_csv(cl.clean_raw(raw_listings_text(spark, sf_dir)))


@register("dedup_keep_first")
def q_dedup(spark, sf_dir):
    return first_per_group(raw_listings_text(spark, sf_dir), list(DEDUP_KEYS), ["src_pos"])


@register("parse_listings")
def q_parse(spark, sf_dir):
    valid, _ = cl.parse_listings(clean_csv_text(spark, sf_dir))
    return valid


@register("validate_required")
def q_rejects(spark, sf_dir):
    _, rejects = cl.parse_listings(clean_csv_text(spark, sf_dir))
    return rejects


def _staged_listings(spark, sf_dir):
    return materialize(_l(spark, sf_dir), "listings-stage")


def _star(spark, sf_dir):
    return st.star_tables(_staged_listings(spark, sf_dir))


for _name in ("brokers", "states", "cities", "zip_codes", "listings", "estate_details", "land_data",
              "addresses"):
    register(f"star_{_name}")(lambda spark, sf_dir, _n=_name: _star(spark, sf_dir)[_n])


@register("listing_details")
def q_details(spark, sf_dir):
    return st.listing_details(_star(spark, sf_dir))


@register("distinct_on")
def q_distinct_on(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
               "l_quantity", "l_extendedprice")
    return first_per_group(li, ["l_orderkey"], ["l_partkey", "l_suppkey", "l_linenumber"])


def parsed_records(spark, sf_dir):
    from domus.session import materialize
    valid, _ = cl.parse_listings(clean_csv_text(spark, sf_dir))
    return materialize(cl.to_wide_listing(valid), "parsed-stage")


@register("null_safe_match")
def q_null_safe(spark, sf_dir):
    recs = parsed_records(spark, sf_dir)
    keys = ["brokered_by", "status", "price"]
    firsts = first_per_group(
        recs.select(*keys, "prev_sold_date", "street", "zip_code", F.col("listing_id").alias("first_id")),
        keys + ["prev_sold_date"], ["street", "zip_code", "first_id"])
    left = st.star_listings(recs)
    return null_safe_match(left, firsts, keys, ["prev_sold_date"]) \
        .select("listing_id", "brokered_by", "status", "price", "prev_sold_date", "street", "zip_code", "first_id")


# ---------------------------------------------------------------- run telemetry


def _records(spark, sf_dir):
    return tm.run_records(runs_from_events(spark, sf_dir))


@register("run_file_metadata")
def q_file_meta(spark, sf_dir):
    runs = runs_from_events(spark, sf_dir)
    from domus.sources.runs import file_metadata
    return runs.select("index", "file_name", *file_metadata(F.col("file_name")))


@register("runs_jsonl_round_trip")
def q_runs_jsonl(spark, sf_dir):
    """K12 + S3: run records written as JSON lines, read back with the explicit schema."""
    from domus.sinks.writers import write_runs_jsonl
    from domus.sources.runs import read_runs
    path = scratch_path(spark, "runs-jsonl")
    write_runs_jsonl(runs_from_events(spark, sf_dir).drop("file_name"), path)
    return read_runs(spark, path).select("index", "run_id", "database", "container", "usecase", "status",
                                         "execution_time_s", "execution_time_ms")


@register("run_records")
def q_run_records(spark, sf_dir):
    return _records(spark, sf_dir)


@register("mean_exec_by_usecase")
def q_mean_uc(spark, sf_dir):
    return tm.mean_exec_by_usecase(_records(spark, sf_dir))


@register("mean_exec_by_day")
def q_mean_day(spark, sf_dir):
    return tm.mean_exec_by_day(_records(spark, sf_dir), 1)


@register("metric_quartiles")
def q_quartiles(spark, sf_dir):
    return tm.metric_quartiles(_records(spark, sf_dir), digits=6)


@register("metric_quartiles_ranked")
def q_quartiles_ranked(spark, sf_dir):
    return tm.metric_quartiles(_records(spark, sf_dir), method="rank", digits=6)


@register("mean_exec_chart")
def q_mean_chart(spark, sf_dir):
    return tm.mean_exec_chart(_records(spark, sf_dir))


@register("resolve_city_ids")
def q_resolve(spark, sf_dir):
    lst = _staged_listings(spark, sf_dir)
    star = st.star_tables(lst)
    return st.resolve_city_ids(lst.select("listing_id", "city", "state"), star["cities"], star["states"])


@register("usecase_catalog")
def q_catalog(spark, sf_dir):
    return tm.usecase_catalog(_records(spark, sf_dir))


@register("telemetry_summary")
def q_telemetry(spark, sf_dir):
    return tm.telemetry_summary(samples_from_events(spark, sf_dir))


@register("cpu_percent")
def q_cpu(spark, sf_dir):
    return tm.snapshot_metrics(snapshots_from_events(spark, sf_dir))


@register("device_counters")
def q_devices(spark, sf_dir):
    return tm.device_counters(snapshots_from_events(spark, sf_dir))


# ---------------------------------------------------------------- quality checks
@register("check_status")
def q_check_status(spark, sf_dir):
    return qa.check_status(parsed_records(spark, sf_dir))


@register("check_not_null")
def q_check_not_null(spark, sf_dir):
    return qa.check_not_null(parsed_records(spark, sf_dir), list(LISTING_COLUMNS))


@register("check_orphans")
def q_check_orphans(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem", "l_orderkey").withColumnRenamed("l_orderkey", "o_orderkey")
    return qa.check_orphans(orders, lines, ["o_orderkey"])


@register("check_foreign_keys")
def q_check_fk(spark, sf_dir):
    return qa.foreign_key_report(_star(spark, sf_dir))


@register("check_unique")
def q_check_unique(spark, sf_dir):
    return qa.check_unique(parsed_records(spark, sf_dir), ["brokered_by", "status", "price", "prev_sold_date"])


# ---------------------------------------------------------------- copy-on-write changes
SNAPSHOT_END = "1998-01-01"   # target table: listings sold before this date
BATCH_START = "1997-01-01"    # incoming batch: listings sold from this date on (one year overlaps)


def _target_batch(spark, sf_dir):
    lst = _l(spark, sf_dir)
    return (lst.where(F.col("prev_sold_date") < F.lit(SNAPSHOT_END).cast("date")),
            lst.where(F.col("prev_sold_date") >= F.lit(BATCH_START).cast("date")))


@register("insert_if_absent")
def q_insert_if_absent(spark, sf_dir):
    target, batch = _target_batch(spark, sf_dir)
    return mu.insert_if_absent(target, batch, ["listing_id"])


@register("insert_new_count")
def q_new_count(spark, sf_dir):
    target, batch = _target_batch(spark, sf_dir)
    return mu.new_keys_count(target, batch, ["listing_id"])


@register("upsert")
def q_upsert(spark, sf_dir):
    target, batch = _target_batch(spark, sf_dir)
    return mu.upsert(target, batch.withColumn("price", adjust_price(0.10)), ["listing_id"])


@register("schema_add_drop")
def q_schema(spark, sf_dir):
    return mu.drop_column_if_exists(mu.add_column_if_missing(_l(spark, sf_dir), "solar_panels", "boolean"), "bath")


# ---------------------------------------------------------------- documents
@register("import_documents")
def q_docs(spark, sf_dir):
    return doc.flatten_documents(doc.to_documents(_l(spark, sf_dir)))


@register("documents_bedrooms_size")
def q_docs_uc6(spark, sf_dir):
    return doc.flatten_documents(doc.documents_bedrooms_size(doc.to_documents(_l(spark, sf_dir)), 2, 150.0))


@register("lookup_unwind")
def q_lookup(spark, sf_dir):
    return doc.lookup_unwind(_l(spark, sf_dir), 500, 250000.0)


@register("uc4_json")
def q_uc4_json(spark, sf_dir):
    return uc.uc4_json_rows(_l(spark, sf_dir), postal_code="10500", below_avg_pct=0.10, city="nation_7")


# ---------------------------------------------------------------- streaming


@register("stream_telemetry")
def q_stream_telemetry(spark, sf_dir):
    """Windowed telemetry over the events file read as a stream (run to completion)."""
    out, ckpt = scratch_path(spark, "tele-out"), scratch_path(spark, "tele-ckpt")
    q = st_tele.telemetry_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet", out, ckpt)
    q.awaitTermination()
    return st_tele.latest_windows(spark, out)


@register("stream_import")
def q_stream_import(spark, sf_dir):
    """Incremental import of the cleaned-CSV export, two files per micro-batch."""
    src, target, ckpt = (scratch_path(spark, n) for n in ("ingest-src", "ingest-target", "ingest-ckpt"))
    clean_csv_text(spark, sf_dir).drop("src_pos").write.option("header", True).csv(src)
    q = st_ingest.import_stream(spark, src, target, ckpt, max_files_per_trigger=2)
    q.awaitTermination()
    return spark.read.parquet(target).drop("listing_id", "batch")


@register("stream_import_skip")
def q_stream_import_skip(spark, sf_dir):
    """ST1, D18: two deliveries imported as a stream that is started again for the
    second; of listings with the same natural key the first one read stays.  The
    later delivery repeats the earlier one with more beds."""
    src, target, ckpt = (scratch_path(spark, n) for n in ("skip-src", "skip-target", "skip-ckpt"))
    every = materialize(clean_csv_text(spark, sf_dir), "skip-export")
    more = F.when(F.col("bed") == "", F.lit("")).otherwise(F.concat(F.lit("1"), "bed"))
    for rows in (every.where("src_pos % 6 < 4"), every.withColumn("bed", more)):
        rows.orderBy("src_pos").drop("src_pos").write.mode("append").option("header", True).csv(src)
        st_ingest.import_stream(spark, src, target, ckpt, max_files_per_trigger=None, on_duplicate="skip").awaitTermination()
    return spark.read.parquet(target).drop("listing_id", "batch")


# ---------------------------------------------------------------- SQL forms


@register("uc1_sql")
def q_uc1_sql(spark, sf_dir):
    sq.register_views(spark, _l(spark, sf_dir), prefix="q_uc1_")
    return sq.uc1_sql(spark, 500, 250000.0, view="q_uc1_listings_wide")


@register("uc5_sql")
def q_uc5_sql(spark, sf_dir):
    sq.register_views(spark, _l(spark, sf_dir), prefix="q_uc5_")
    return sq.uc5_sql(spark, view="q_uc5_listings_wide") \
        .withColumn("avg_price_per_sqm", round_half_up("avg_price_per_sqm", 4))


from domus.plans import stored  # noqa: E402,F401  (registers the queries that write and read back)
