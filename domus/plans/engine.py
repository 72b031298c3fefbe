"""``ListingsEngine``: the use-case contract over plain partitioned Parquet.

The table is ``<base>/rows``, partitioned by import, kind of line and part of
the brokers, sorted by city inside.  An import writes its own partitions and
is seen when its record under ``<base>/imports`` is written, last.  UC2 and
UC3 replace the partitions that hold changed rows: UC2 those of one broker's
part, UC3, which fills a column of every row, all of them.  A table has one
writer at a time; a reader that is replaced under asks for ``table()`` again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domus import params
from domus.operators import usecases as uc
from domus.operators.joins import first_per_group, null_safe_match
from domus.operators.mutate import add_column_if_missing
from domus.schema import (
    DEFAULT_BELOW_AVG_PCT, DEFAULT_BROKER_ID, DEFAULT_CITY, DEFAULT_LIMIT, DEFAULT_MAX_PRICE,
    DEFAULT_MAX_SIZE_SQM, DEFAULT_MIN_BEDROOMS, DEFAULT_MIN_LISTINGS, DEFAULT_PERCENT_DELTA,
    DEFAULT_POSTAL_CODE, LISTING, LISTING_COLUMNS,
)
from domus.session import materialize, path_exists
from domus.sinks import imports
from domus.sinks.partitioned import change_rows, read_table, replace_partitions

# Natural key of a listing: two rows equal on it are the same listing
# (used by the duplicate policy of imports; NULLs compare equal).
NATURAL_KEY = ("brokered_by", "status", "price", "prev_sold_date", "street", "zip_code", "city", "state")
SOLAR = "solar_panels"
STORED = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in LISTING.fields), f"{SOLAR} boolean", imports.ORIGIN,
                    "import_no int, kind string, broker_part int"])


class ListingsEngine:
    def __init__(self, spark: SparkSession, base_path: str, broker_parts: int = 16):
        """``broker_parts``: folders of an import that its brokers are dealt to."""
        self.spark, self.base, self.broker_parts = spark, base_path.rstrip("/"), broker_parts

    # ------------------------------------------------------------ the table
    @property
    def rows_path(self) -> str:
        return f"{self.base}/rows"

    def imports(self) -> DataFrame:
        """Counts of each import: lines that were valid, rejected and skipped."""
        return read_table(self.spark, f"{self.base}/imports", "import_no int, imported long, rejected long, skipped long, stored long")

    def stored(self) -> DataFrame:
        """All lines of all finished imports, with their kind and origin."""
        return read_table(self.spark, self.rows_path, STORED).where(F.col("import_no") <= self._last_import())

    def _last_import(self) -> int:
        """Number of the last finished import, from the names of the records (no job)."""
        records = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/imports/import_no=*/part-*")
        found = records.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(records) or []
        return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found), default=0)

    def _listings(self) -> DataFrame:
        """The listings with the columns that place them."""
        return self.stored().where(F.col("kind") == imports.VALID)

    def _has_solar(self) -> bool:
        return path_exists(self.spark, f"{self.base}/columns/{SOLAR}")

    def table(self) -> DataFrame:
        """The listings; with ``solar_panels`` once UC3 has run (NULL in rows imported later)."""
        return self._listings().select(*LISTING_COLUMNS, *([SOLAR] if self._has_solar() else []))

    def rejects(self, import_no: int, parts: bool = False) -> DataFrame:
        """(src_file, line, reasons, line_text) of an import's rejected lines; with ``parts``
        the files are one text, and lines count through them in the order of their names."""
        return imports.rejects_with_lines(self.stored().where(F.col("import_no") == import_no), parts)

    def reset_database(self) -> None:
        """Remove the table's rows, records and added columns; ids start again."""
        for name in ("imports", "columns", "rows"):  # the records first: without them no row is seen
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def get_total_count(self) -> int:
        return self._listings().count()  # from the files' footers

    # ------------------------------------------------------------ UC7
    def usecase7_bulk_import(self, data: DataFrame | str, batch_size: int = 0, on_duplicate: str = "append") -> dict[str, int]:
        """Import cleaned-CSV text (a path, or a text DataFrame).

        One pass over the input writes valid listings, rejects and skipped
        lines (``sinks.imports``), in files of at most ``batch_size`` rows (0 =
        no cap).  Ids are unique by construction and the same when a task is
        run again.  ``on_duplicate="append"`` imports every valid row; with
        ``"skip"`` the first row per natural key (``NATURAL_KEY``, NULLs equal)
        stays and keys already in the table are dropped, which takes a staged
        copy.  Returns {'imported', 'rejected'}, imported before that policy.
        """
        if on_duplicate not in ("append", "skip"):
            raise ValueError("on_duplicate must be 'append' or 'skip'")
        if not isinstance(batch_size, int) or batch_size < 0:
            raise ValueError("batch_size must be a non-negative integer")
        number = self._last_import() + 1
        rows = imports.parsed_lines(data, number, self.spark, self.broker_parts)
        dropped = 0
        if on_duplicate == "skip":
            staged = materialize(rows, "import-rows")
            valid = staged.where(F.col("kind") == imports.VALID)
            first = first_per_group(valid.select(*NATURAL_KEY, "listing_id"), list(NATURAL_KEY), ["listing_id"])
            new = null_safe_match(first, self.table().select(*NATURAL_KEY).dropDuplicates(), [], list(NATURAL_KEY), how="left_anti")
            new = materialize(new.select("listing_id"), "import-new")
            dropped = valid.count() - new.count()
            rows = staged.where(F.col("kind") != imports.VALID).unionByName(valid.join(new, "listing_id", "left_semi"))
        return self._publish(rows, number, batch_size, dropped)

    def import_listings(self, listings: DataFrame, batch_size: int = 0) -> dict[str, int]:
        """Import typed listings under their own ids."""
        number = self._last_import() + 1
        return self._publish(imports.as_import(listings, number, self.broker_parts), number, batch_size)

    def _publish(self, rows: DataFrame, number: int, batch_size: int, dropped: int = 0) -> dict[str, int]:
        """Write an import's rows, then the record that makes it seen."""
        seen = imports.write_import(rows, self.rows_path, batch_size)
        valid = seen[imports.VALID] + dropped
        record = (valid, seen[imports.REJECT], seen[imports.SKIPPED], seen[imports.VALID])
        self.spark.createDataFrame([record], "imported long, rejected long, skipped long, stored long").coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.base}/imports/import_no={number}")
        return {"imported": valid, "rejected": seen[imports.REJECT]}

    # ------------------------------------------------------------ reads
    def usecase1_filter_properties(self, min_listings: int = DEFAULT_MIN_LISTINGS,
                                   max_price: float = DEFAULT_MAX_PRICE) -> DataFrame:
        return uc.uc1_filter_properties(self.table(), min_listings, max_price)

    def usecase4_price_analysis(self, postal_code: str = DEFAULT_POSTAL_CODE,
                                below_avg_pct: float = DEFAULT_BELOW_AVG_PCT, city: str = DEFAULT_CITY,
                                state: str | None = None, **checks: bool) -> dict[str, DataFrame]:
        """``checks``: what ``usecases.uc4_price_analysis`` takes besides."""
        return uc.uc4_price_analysis(self.table(), postal_code, below_avg_pct, city, state, **checks)

    def usecase5_average_price_per_city(self, require_positive_price: bool = True) -> DataFrame:
        return uc.uc5_avg_price_per_city(self.table(), require_positive_price)

    def usecase6_filter_by_bedrooms_and_size(self, min_bedrooms: int = DEFAULT_MIN_BEDROOMS,
                                             max_size: float = DEFAULT_MAX_SIZE_SQM) -> DataFrame:
        return uc.uc6_filter_by_bedrooms_and_size(self.table(), min_bedrooms, max_size)

    # ------------------------------------------------------------ changes
    def usecase2_update_prices(self, broker_id: str = DEFAULT_BROKER_ID,
                               percent_delta: float = DEFAULT_PERCENT_DELTA, limit: int = DEFAULT_LIMIT,
                               skip_null_price: bool = False, validate: bool = False) -> int:
        """Price change of a broker's first ``limit`` listings: the folders that hold them
        are replaced; returns rows changed."""
        part = params.parse_int_text(broker_id, "broker_id") % self.broker_parts
        table = self._listings().where(F.col("broker_part") == part)
        changed = materialize(uc.uc2_changed_rows(table, broker_id, percent_delta, limit, skip_null_price, validate), "uc2")
        change_rows(table, self.rows_path, changed, "listing_id", imports.PLACE, imports.SORT)
        return changed.count()

    def usecase3_add_solar_panels(self) -> int:
        """Add ``solar_panels`` and fill it in every row: a reproducible ~50% flag of the id.
        Returns the number of rows; rows imported later have NULL until it runs again."""
        rows = self._listings()
        replace_partitions(uc.uc3_add_solar_panels(rows).select(*rows.columns), self.rows_path, imports.PLACE, imports.SORT)
        add_column_if_missing(self.spark.range(1), SOLAR, "boolean").write.mode("overwrite").parquet(f"{self.base}/columns/{SOLAR}")
        return self.get_total_count()
