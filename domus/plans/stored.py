"""Registered queries that write with the sinks and read back with the sources.

Every one works on the whole listing projection (or all events): text files,
documents, the star tables and the engine's table are written to the shared
checkpoint folder, and the result comes from what a reader finds there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from domus.functions.measures import adjust_price
from domus.operators import cleaning as cl
from domus.operators import documents as doc
from domus.operators import quality as qa
from domus.operators import star as st
from domus.operators import telemetry as tm
from domus.plans.catalog import register
from domus.plans.engine import ListingsEngine
from domus.schema import LISTING_COLUMNS, RUN
from domus.session import materialize, scratch_path
from domus.sinks import writers
from domus.sinks.layout import write_interleaved
from domus.sinks.star_load import Star
from domus.sources.derived import clean_csv_text, raw_listings_text
from domus.sources.files import FILE_ORDER, json_lines, read_clean_csv, read_lines, read_raw_csv, with_line_numbers
from domus.sources.runs import runs_from_events, runs_with_samples
from domus.sources.tables import listings_from_tables


@register("raw_csv_clean")
def q_raw_csv(spark, sf_dir):
    """The raw export as CSV files, read and cleaned; first in file order stays."""
    path = scratch_path(spark, "raw-csv")
    raw_listings_text(spark, sf_dir).drop("src_pos").write.option("header", True).csv(path)
    return cl.clean_raw(read_raw_csv(spark, path), FILE_ORDER).drop(*FILE_ORDER)


@register("clean_csv_parse")
def q_clean_csv(spark, sf_dir):
    """K1 + S1: cleaned listings as CSV files, read and parsed."""
    path = scratch_path(spark, "clean-csv")
    writers.write_clean_csv(cl.clean_raw(raw_listings_text(spark, sf_dir)).drop("src_pos"), path)
    valid, _ = cl.parse_listings(read_clean_csv(spark, path))
    return valid.drop("src_pos")


@register("stored_documents_bedrooms_size")
def q_stored_docs(spark, sf_dir):
    """K3 + S7: documents written, read back and filtered on nested fields."""
    path = scratch_path(spark, "documents")
    writers.write_documents(doc.to_documents(listings_from_tables(spark, sf_dir)), path)
    return doc.flatten_documents(doc.documents_bedrooms_size(spark.read.parquet(path), 2, 150.0))


def _stored_star(spark, sf_dir):
    paths = writers.write_star(listings_from_tables(spark, sf_dir), scratch_path(spark, "star"))
    return writers.read_star(spark, paths)


@register("stored_star_details")
def q_stored_star(spark, sf_dir):
    """K4: the eight tables written, and the detail join over what is read back."""
    return st.listing_details(_stored_star(spark, sf_dir))


@register("stored_star_counts")
def q_star_counts(spark, sf_dir):
    """K4: rows that the load left in each of the eight tables."""
    counts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
              for name, df in _stored_star(spark, sf_dir).items()]
    return reduce(lambda a, b: a.union(b), counts)


def _star_batches(spark, sf_dir):
    """Two overlapping batches of the listings, the later one with other prices and beds;
    some rows of each have a status that the star doesn't know."""
    lst, k = materialize(listings_from_tables(spark, sf_dir), "star-listings"), F.col("listing_id")
    unknown = lambda n: F.when(k % n == 0, F.lit("withdrawn")).otherwise(F.col("status"))
    first = lst.where("zip_code < 11800").withColumn("status", unknown(97))
    later = lst.where("zip_code >= 11200").withColumn("status", unknown(89)) \
        .withColumn("price", adjust_price(0.10)).withColumn("bed", F.col("bed") + 1)
    return first, later


@register("star_incremental_load")
def q_star_incremental(spark, sf_dir):
    """An overlapping batch loaded into the star of the first one; the
    details as read back, with the ids of city and state."""
    star = Star(spark, scratch_path(spark, "star-loads"))
    for batch in _star_batches(spark, sf_dir):
        star.load(batch)
    t = star.tables()
    ids = t["addresses"].join(t["cities"], "city_id").select("listing_id", "city_id", "state_id")
    return st.listing_details(t).join(ids, "listing_id")


@register("star_load_counts")
def q_star_loads(spark, sf_dir):
    """What each load counted; the third one is the second batch again."""
    star = Star(spark, scratch_path(spark, "star-loads"))
    first, later = _star_batches(spark, sf_dir)
    for batch in (first, later, later):
        star.load(batch)
    bad = star.quarantine().where("reasons = 'status'").groupBy("load").agg(F.count(F.lit(1)).alias("n_bad_status"))
    return star.loads().join(bad, "load", "left")


@register("check_unique_keys")
def q_unique_keys(spark, sf_dir):
    """V4: key values that a star table holds more than once, for every key."""
    return qa.unique_key_report(_stored_star(spark, sf_dir))


def _imported(spark, sf_dir):
    engine = ListingsEngine(spark, scratch_path(spark, "engine"))
    engine.usecase7_bulk_import(clean_csv_text(spark, sf_dir).drop("src_pos"))
    return engine


@register("engine_import")
def q_engine_import(spark, sf_dir):
    """UC7: the cleaned export imported; ids depend on the input's order and are left out."""
    return _imported(spark, sf_dir).table().drop("listing_id")


@register("engine_uc2_uc3")
def q_engine_changes(spark, sf_dir):
    """UC3, then UC2 over up to 100,000 listings of a broker, read back from the table."""
    engine = _imported(spark, sf_dir)
    engine.usecase3_add_solar_panels()
    engine.usecase2_update_prices(broker_id="605.00", percent_delta=0.05, limit=100_000)
    return engine.table().select("*", F.col("solar_panels").isNotNull().alias("has_flag")) \
        .drop("listing_id", "solar_panels")


def _keyed(spark, sf_dir):
    """An engine whose table holds the listing projection under its own ids."""
    engine = ListingsEngine(spark, scratch_path(spark, "engine"))
    engine.import_listings(listings_from_tables(spark, sf_dir))
    return engine


@register("uc2_stored")
def q_uc2_stored(spark, sf_dir):
    """K7: a broker's first ten prices changed in the stored table, read back with ids."""
    engine = _keyed(spark, sf_dir)
    engine.usecase2_update_prices("605.00", 0.05, 10)
    return engine.table()


@register("uc3_stored")
def q_uc3_stored(spark, sf_dir):
    """K8: the flag filled in every stored row."""
    engine = _keyed(spark, sf_dir)
    engine.usecase3_add_solar_panels()
    return engine.table()


@register("reset_and_import")
def q_reset(spark, sf_dir):
    """K6: rows after an import, after a reset, and after a second import."""
    engine, counts = _keyed(spark, sf_dir), []
    for step in ("import", "reset", "again"):
        if step == "reset":
            engine.reset_database()
        elif step == "again":
            engine.import_listings(listings_from_tables(spark, sf_dir))
        counts.append(engine.table().agg(F.count(F.lit(1)).alias("n_rows"), F.max("listing_id").alias("top_id"))
                      .select(F.lit(step).alias("step"), "n_rows", "top_id").first())
    return spark.createDataFrame(counts, "step string, n_rows long, top_id long")


# lines that a reader must not take for listings, by the listing's id
BROKEN = ((101, "short"), (103, "long"), (107, "quote"), (109, "blank"))


def _broken_export(spark, sf_dir):
    """The cleaned export as one text, in parts whose names are in file order, with lines
    that are broken.  Staged, as cutting it into parts reads it twice."""
    rows = clean_csv_text(spark, sf_dir)
    names = [c for c in rows.columns if c != "src_pos"]
    line, k = F.concat_ws(",", *names), F.floor(F.col("src_pos") / 2)
    broken = {"short": F.concat_ws(",", *names[:4]), "long": F.concat(line, F.lit(",x,y")),
              "quote": F.concat(F.lit('"'), line), "blank": F.lit("")}
    text = line
    for n, how in BROKEN:
        text = F.when(k % n == 0, broken[how]).otherwise(text)
    path = scratch_path(spark, "broken-export")
    head = spark.range(1).select(F.lit(-1).cast("long").alias("src_pos"), F.lit(",".join(names)).alias("value"))
    lines = materialize(head.union(rows.select("src_pos", text.alias("value"))), "broken-lines")
    lines.orderBy("src_pos").select("value").write.text(path)
    return path


@register("import_wide")
def q_import_wide(spark, sf_dir):
    """The export imported in one pass; every listing with the line that its id names."""
    engine = ListingsEngine(spark, scratch_path(spark, "engine"))
    engine.usecase7_bulk_import(_broken_export(spark, sf_dir))
    every = engine.stored()
    valid = every.where("kind = 'valid'").select("listing_id", "src_file", "src_block", *LISTING_COLUMNS[1:])
    return with_line_numbers(valid, every.select("listing_id", "src_file", "src_block"), parts=True) \
        .drop("listing_id", "src_file", "src_block")


@register("import_interleaved")
def q_import_interleaved(spark, sf_dir):
    """The listings written along a curve through broker and zip, read back."""
    path = scratch_path(spark, "interleaved")
    write_interleaved(listings_from_tables(spark, sf_dir), path)
    return spark.read.parquet(path)


@register("import_rejects")
def q_import_rejects(spark, sf_dir):
    """The lines that the import left out, with place, text and reasons."""
    engine = ListingsEngine(spark, scratch_path(spark, "engine"))
    engine.usecase7_bulk_import(_broken_export(spark, sf_dir))
    return engine.rejects(1, parts=True).drop("src_file")


@register("runs_jsonl_rejects")
def q_runs_rejects(spark, sf_dir):
    """S3: run records as JSON lines, some cut off; every line is a record or a reject."""
    path = scratch_path(spark, "broken-runs")
    runs = runs_from_events(spark, sf_dir).drop("file_name")
    whole = F.to_json(F.struct(*runs.columns))
    runs.select(F.when(F.col("index") % 50 == 7, F.concat(F.lit('{"index": '), F.col("index").cast("string"))).otherwise(whole)
                .alias("value")).write.text(path)
    lines = json_lines(read_lines(spark, path), RUN).where(~F.col("skipped"))
    return lines.select(F.when(~F.col("malformed"), F.col("index")).alias("index"), "malformed",
                        F.when(~F.col("malformed"), F.col("run_id")).alias("run_id"),
                        F.when(F.col("malformed"), F.col("line_text")).alias("line_text"))


@register("import_counts")
def q_import_counts(spark, sf_dir):
    """K5: what two imports of the export counted, the second without listings already there."""
    engine, path = ListingsEngine(spark, scratch_path(spark, "engine")), _broken_export(spark, sf_dir)
    engine.usecase7_bulk_import(path, on_duplicate="skip")
    engine.usecase7_bulk_import(path, on_duplicate="skip")
    return engine.imports()


@register("run_sample_summaries")
def q_run_samples(spark, sf_dir):
    """Every run record's own samples summarized inside its row."""
    return tm.summarize_samples(runs_with_samples(spark, sf_dir)).select(
        "index", "avg_cpu", "peak_cpu", "avg_mem", "peak_mem", "total_blkio_mb", "n_samples")


@register("runs_by_timestamp")
def q_runs_ordered(spark, sf_dir):
    """Run records from the oldest to the newest."""
    return tm.runs_by_timestamp(tm.run_records(runs_from_events(spark, sf_dir)))
