"""Incremental load of listings into an existing star.

A load inserts what is absent and updates details: dimension values that are
new get the next dense ids after those in use (ids once given never move),
listings whose id is new are inserted, estate details, land data and addresses
are inserted or, for a listing that has them, replaced where they differ.

Write, audit, publish.  The batch is staged in one pass that also counts what
is wrong with it; rows that break a rule of the star (status, missing keys) go
to ``quarantine``.  Every table is plain Parquet, partitioned by load;
``loads`` gets a record last, and readers see the loads that have one.  A load
that died is run again under its number and replaces what it left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from domus.functions.ids import with_next_ids
from domus.operators import star as st
from domus.operators.joins import first_per_group
from domus.schema import STATUS_VALUES
from domus.session import materialize
from domus.sinks.partitioned import change_rows, read_table, replace_partitions

DIMENSIONS = {
    "brokers": "brokered_by int, load long",
    "states": "state_id long, state_name string, load long",
    "cities": "city_id long, city_name string, state_id long, load long",
    "zip_codes": "zip_code int, load long",
}
LISTINGS = "listing_id long, brokered_by int, status string, price double, prev_sold_date date, load long"
DETAILS = {
    "estate_details": "listing_id long, bed int, bath int, house_size double",
    "land_data": "listing_id long, area_size_in_square_m double",
    "addresses": "listing_id long, street double, zip_code int, city_id long",
}
PLACE = ("load", "id_range")  # partition columns of the detail tables
LOADS = "load long, n_rows long, n_quarantined long, n_new long, n_updated long"
BAD_STATUS, NO_ID, NO_BROKER = "status", "listing_id", "brokered_by"


@dataclass(frozen=True)
class Loaded:
    load: int
    rows: int          # of the batch
    quarantined: int
    new: int           # listings inserted
    updated: int       # detail rows replaced


def broken_rules() -> Column:
    """Names of the rules that a row breaks; a null status is allowed."""
    rules = [(BAD_STATUS, F.col("status").isNotNull() & ~F.col("status").isin(list(STATUS_VALUES))),
             (NO_ID, F.col("listing_id").isNull()), (NO_BROKER, F.col("brokered_by").isNull())]
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))


class Star:
    """The star under ``base``; ``id_range`` listing ids share a folder of a detail table."""

    def __init__(self, spark: SparkSession, base: str, id_range: int = 1 << 20):
        self.spark, self.base, self.id_range = spark, base.rstrip("/"), id_range

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def loads(self) -> DataFrame:
        return read_table(self.spark, self.path("loads"), LOADS)

    def last_load(self) -> int:
        return self.loads().agg(F.max("load")).first()[0] or 0

    def _rows(self, name: str, upto: int) -> DataFrame:
        schema = {**DIMENSIONS, "listings": LISTINGS, **{k: f"{v}, load long, id_range long" for k, v in DETAILS.items()}}[name]
        return read_table(self.spark, self.path(name), schema).where(F.col("load") <= upto)

    def tables(self) -> dict[str, DataFrame]:
        """The eight tables of all published loads."""
        last = self.last_load()
        return {n: self._rows(n, last).drop(*PLACE) for n in (*DIMENSIONS, "listings", *DETAILS)}

    def quarantine(self) -> DataFrame:
        """Rows left out of published loads, with ``reasons`` and ``load``."""
        return self.spark.read.parquet(self.path("quarantine")).where(F.col("load") <= self.last_load())

    def _insert(self, name: str, rows: DataFrame, load: int) -> DataFrame:
        """Write a load's own folder and return all rows up to it."""
        rows.write.mode("overwrite").parquet(f"{self.path(name)}/load={load}")
        return self._rows(name, load)

    def _dimensions(self, valid: DataFrame, load: int) -> dict[str, DataFrame]:
        """Insert the dimension values that no load before had."""
        before = {n: self._rows(n, load - 1) for n in DIMENSIONS}
        out = {}
        for name, col in (("brokers", "brokered_by"), ("zip_codes", "zip_code")):
            found = valid.select(col).where(F.col(col).isNotNull()).distinct()
            out[name] = self._insert(name, found.join(before[name], col, "left_anti"), load)

        def numbered(name: str, new: DataFrame, key: list[str], id_col: str) -> DataFrame:
            top = before[name].agg(F.max(id_col)).first()[0] or 0
            return self._insert(name, with_next_ids(new.join(before[name], key, "left_anti"), key, id_col, top + 1), load)

        states = valid.select(F.col("state").alias("state_name")).where("state_name is not null").distinct()
        out["states"] = numbered("states", states, ["state_name"], "state_id").drop("load")
        pairs = valid.select(F.col("city").alias("city_name"), F.col("state").alias("state_name")) \
            .where("city_name is not null and state_name is not null").distinct()
        cities = pairs.join(out["states"], "state_name").select("city_name", "state_id")
        out["cities"] = numbered("cities", cities, ["city_name", "state_id"], "city_id").drop("load")
        return out

    def _details(self, name: str, rows: DataFrame, load: int) -> int:
        """Insert the details of listings that have none, replace those that differ;
        returns how many were replaced."""
        values = [c for c in rows.columns if c != "listing_id"]
        before = self._rows(name, load - 1)
        held = before.select("listing_id", "load", "id_range", F.struct(*values).alias("held"))
        met = materialize(rows.join(held, "listing_id", "left"), f"{name}-met")
        own = F.floor(F.col("listing_id") / F.lit(self.id_range)).cast("long")
        fresh = met.where("load is null").select("listing_id", *values, F.lit(load).cast("long").alias("load"), own.alias("id_range"))
        replace_partitions(fresh, self.path(name), PLACE, ["listing_id"])
        differ = met.where(F.col("load").isNotNull() & ~F.struct(*values).eqNullSafe(F.col("held")))
        n = differ.count()
        if n:
            change_rows(before, self.path(name), differ.select(*before.columns), "listing_id", PLACE, ["listing_id"])
        return n

    def load(self, listings: DataFrame) -> Loaded:
        """Load a batch of listings (wide columns); of rows that repeat an id in the
        batch the first by its values stays.  Loading a batch twice changes nothing."""
        load = self.last_load() + 1
        audit = Observation(f"star-load-{load}")
        reasons = F.col("reasons")
        counted = listings.withColumn("reasons", broken_rules()).observe(
            audit, F.count(F.lit(1)).alias("rows"), F.count(F.when(F.size(reasons) > 0, 1)).alias("bad"))
        staged = materialize(counted, "star-batch")
        seen = audit.get
        staged.where(F.size(reasons) > 0).withColumn("reasons", F.array_join(reasons, ",")) \
            .write.mode("overwrite").parquet(f"{self.path('quarantine')}/load={load}")
        valid = materialize(first_per_group(staged.where(F.size(reasons) == 0).drop("reasons"), ["listing_id"], []), "star-valid")
        dims = self._dimensions(valid, load)
        known = self._rows("listings", load - 1).select("listing_id")
        self._insert("listings", st.star_listings(valid).join(known, "listing_id", "left_anti"), load)
        new = self.spark.read.parquet(f"{self.path('listings')}/load={load}").count()  # from the files' footers
        complete = F.col("street").isNotNull() & F.col("zip_code").isNotNull()
        placed = st.resolve_city_ids(valid.where(complete), dims["cities"], dims["states"]).where("city_id is not null")
        details = {"estate_details": st.star_estate_details(valid), "land_data": st.star_land_data(valid),
                   "addresses": placed.select("listing_id", "street", "zip_code", "city_id")}
        updated = sum(self._details(name, rows, load) for name, rows in details.items())
        out = Loaded(load, int(seen["rows"]), int(seen["bad"]), new, updated)
        self.spark.createDataFrame([(out.rows, out.quarantined, out.new, out.updated)], LOADS.split(", ", 1)[1]) \
            .coalesce(1).write.mode("overwrite").parquet(f"{self.path('loads')}/load={load}")
        return out
