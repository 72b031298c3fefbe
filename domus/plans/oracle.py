"""Independent DuckDB SQL for every registered query (the correctness oracle).

Written by hand against the base tables (registered as views by the checker);
it shares no code with the Spark implementation.  ``LISTINGS_CTE`` is the SQL
form of the listing projection of the TPC-H-like tables.
"""

from __future__ import annotations

LISTINGS_CTE = """
x AS (
  SELECT l_orderkey,
         CAST(SUM(n_lines) AS INTEGER) AS bed,
         CAST(COUNT(*) AS INTEGER) AS bath,
         CAST(SUM(size_sum) AS DOUBLE) AS house_size_sqm,
         SUM(qty_sum) AS lot_size_sqm
  FROM (SELECT l_orderkey, l_suppkey, COUNT(*) AS n_lines, SUM(p_size) AS size_sum,
               SUM(l_quantity) AS qty_sum
        FROM lineitem JOIN part ON l_partkey = p_partkey
        GROUP BY l_orderkey, l_suppkey) s
  GROUP BY l_orderkey
),
L AS (
  SELECT o.o_orderkey AS listing_id,
         CAST(o.o_custkey AS INTEGER) AS brokered_by,
         CASE o.o_orderstatus WHEN 'F' THEN 'sold' WHEN 'O' THEN 'for_sale' ELSE 'ready_to_build' END AS status,
         o.o_totalprice AS price,
         x.lot_size_sqm,
         CAST(o.o_orderkey AS DOUBLE) AS street,
         n.n_name AS city,
         r.r_name AS state,
         CAST(10000 + c.c_nationkey * 100 + o.o_custkey % 10 AS INTEGER) AS zip_code,
         x.bed, x.bath, x.house_size_sqm,
         CAST(o.o_orderdate AS DATE) AS prev_sold_date
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN x ON x.l_orderkey = o.o_orderkey
)"""

LCOLS = ("listing_id, brokered_by, status, price, lot_size_sqm, street, city, state, zip_code, "
         "bed, bath, house_size_sqm, prev_sold_date")


def with_listings(body: str, extra_ctes: str = "") -> str:
    ctes = LISTINGS_CTE + ("," + extra_ctes if extra_ctes else "")
    return f"WITH {ctes}\n{body}"


ORACLE: dict[str, str] = {}


def rnd(e: str, d: int) -> str:
    """Half-up rounding on the decimal value (matches the Spark side)."""
    return f"CAST(ROUND(CAST({e} AS DECIMAL(38,10)), {d}) AS DOUBLE)"

# ---------------------------------------------------------------- use cases
ORACLE["listings"] = with_listings(f"SELECT {LCOLS} FROM L")

ORACLE["uc1_filter_properties"] = with_listings(f"""
SELECT {LCOLS} FROM L
WHERE price < 250000.0
  AND (city, state) IN (SELECT city, state FROM L WHERE city IS NOT NULL AND state IS NOT NULL
                        GROUP BY city, state HAVING COUNT(*) > 500)
ORDER BY city, state, price, listing_id""")

ORACLE["cities_with_min_listings"] = with_listings("""
SELECT city, state, COUNT(*) AS n_listings FROM L
WHERE city IS NOT NULL AND state IS NOT NULL
GROUP BY city, state HAVING COUNT(*) > 500""")

ORACLE["uc2_update_prices"] = with_listings("""
SELECT L.listing_id, brokered_by, status,
       CASE WHEN t.listing_id IS NOT NULL
            THEN CAST(CAST(CAST(price AS DECIMAL(16,2)) * CAST(1.05 AS DECIMAL(8,2)) AS DECIMAL(16,2)) AS DOUBLE)
            ELSE price END AS price,
       lot_size_sqm, street, city, state, zip_code, bed, bath, house_size_sqm, prev_sold_date,
       t.listing_id IS NOT NULL AS updated
FROM L LEFT JOIN (SELECT listing_id FROM L WHERE brokered_by = 605 ORDER BY listing_id LIMIT 10) t
  ON L.listing_id = t.listing_id""")

ORACLE["uc3_solar_panels"] = with_listings(f"""
SELECT {LCOLS}, substr(md5(CAST(listing_id AS VARCHAR)), 1, 1) < '8' AS solar_panels FROM L""")

ORACLE["uc4_below_threshold"] = with_listings(f"""
SELECT {LCOLS}, price_per_sqm FROM (
  SELECT *, CAST(price AS DOUBLE) / NULLIF(lot_size_sqm, 0) AS price_per_sqm,
         AVG(CAST(price AS DOUBLE) / NULLIF(lot_size_sqm, 0)) OVER () AS zavg
  FROM L WHERE zip_code = 10500 AND lot_size_sqm > 0 AND price > 0 AND price IS NOT NULL) z
WHERE zavg > 0 AND price_per_sqm < zavg * (1 - 0.10)
ORDER BY price_per_sqm, listing_id""")

ORACLE["uc4_sorted_by_city"] = with_listings(f"""
SELECT {LCOLS} FROM L
WHERE lower(trim(city)) = 'nation_7' AND price > 0
ORDER BY price ASC NULLS LAST, listing_id""")

ORACLE["uc5_avg_price_per_city"] = with_listings(f"""
SELECT city || ', ' || state AS city_state, city, state,
       {rnd('AVG(CAST(price AS DOUBLE) / NULLIF(lot_size_sqm, 0))', 4)} AS avg_price_per_sqm
FROM L
WHERE lot_size_sqm > 0 AND price > 0 AND city IS NOT NULL AND state IS NOT NULL
GROUP BY city, state
HAVING AVG(CAST(price AS DOUBLE) / NULLIF(lot_size_sqm, 0)) IS NOT NULL
ORDER BY state, city""")

ORACLE["uc6_bedrooms_size"] = with_listings(f"""
SELECT {LCOLS} FROM L WHERE bed > 2 AND house_size_sqm < 150.0""")

ORACLE["avg_if"] = with_listings(f"""
SELECT city, state,
       {rnd('AVG(CAST(price AS DOUBLE) / NULLIF(lot_size_sqm, 0)) FILTER (WHERE lot_size_sqm > 0 AND price > 100000.0)', 4)} AS avg_price_per_sqm,
       COUNT(*) FILTER (WHERE lot_size_sqm > 0 AND price > 100000.0) AS n_eligible
FROM L GROUP BY city, state""")

ORACLE["price_per_sqm"] = with_listings("""
SELECT listing_id, CAST(price AS DOUBLE) / NULLIF(lot_size_sqm, 0) AS price_per_sqm FROM L""")

ORACLE["top_n_per_broker"] = with_listings(f"""
SELECT {LCOLS}, rank_in_broker FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY brokered_by ORDER BY listing_id) AS INTEGER) AS rank_in_broker
  FROM L) t WHERE rank_in_broker <= 3""")

ORACLE["total_count"] = with_listings("SELECT COUNT(*) AS n_rows FROM L")


# ---------------------------------------------------------------- text exports
def strip_sql(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def title_sql(e: str) -> str:
    return ("array_to_string(list_transform(regexp_extract_all(" + strip_sql(e) + ", '[A-Za-z]+|[^A-Za-z]+'), "
            "lambda x: upper(x[1]) || lower(x[2:])), '')")


def num_sql(e: str) -> str:
    return (f"(CASE WHEN isnan(TRY_CAST(trim({e}) AS DOUBLE)) THEN NULL "
            f"ELSE TRY_CAST(trim({e}) AS DOUBLE) END)")


def strict_int_sql(e: str) -> str:
    return f"(CASE WHEN regexp_full_match(trim({e}), '[+-]?[0-9]+') THEN TRY_CAST(trim({e}) AS INTEGER) END)"


def ts_sql(e: str) -> str:
    return (f"(CASE WHEN trim({e}) LIKE '%T%+%' THEN timezone('UTC', TRY_CAST(trim({e}) AS TIMESTAMPTZ)) "
            f"ELSE TRY_CAST(trim({e}) AS TIMESTAMP) END)")


def record_ts_sql(e: str) -> str:
    """Of whole dates only, also written without dashes."""
    d = f"regexp_replace({e}, '^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})($|[T ])', '\\1-\\2-\\3\\4')"
    return f"(CASE WHEN regexp_matches({d}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}($|[T ])') THEN {ts_sql(d)} END)"


def dirty_cte(layout: str) -> str:
    if layout == "raw":
        lot = "printf('%.4f', lot_size_sqm / 100.0)"
        house = "printf('%.1f', house_size_sqm * 10.0)"
        names = ("acre_lot", "house_size")
    else:
        lot = "printf('%.2f', lot_size_sqm)"
        house = "printf('%.2f', house_size_sqm)"
        names = ("lot_size_sqm", "house_size_sqm")
    k = "listing_id"
    forms = "" if layout == "raw" else f"""WHEN {k} % 59 = 0 THEN strftime(prev_sold_date, '%Y%m%d')
         WHEN {k} % 61 = 0 THEN strftime(prev_sold_date, '%Y-%m')
         WHEN {k} % 67 = 0 THEN strftime(prev_sold_date, '%Y-%m-%d') || ' 13:45:10'"""
    return f"""
dup AS (SELECT *, 0 AS _copy FROM L
        UNION ALL SELECT * REPLACE (bed + 1 AS bed), 1 AS _copy FROM L WHERE {k} % 41 = 0),
txt AS (
  SELECT {k} * 2 + _copy AS src_pos,
    CASE WHEN {k} % 53 = 0 THEN '' ELSE CAST(brokered_by AS VARCHAR) || '.0' END AS brokered_by,
    CASE WHEN {k} % 97 = 0 THEN 'nan' WHEN {k} % 89 = 0 THEN '' ELSE status END AS status,
    CASE WHEN {k} % 37 = 0 THEN 'nan' WHEN {k} % 71 = 0 THEN printf('%.2f', price) || 'd'
         WHEN {k} % 83 = 0 THEN '0x1p3' ELSE printf('%.2f', price) END AS price,
    CASE WHEN bed IS NULL THEN '' WHEN {k} % 11 = 0 THEN CAST(bed AS VARCHAR) || '.0'
         ELSE CAST(bed AS VARCHAR) END AS bed,
    COALESCE(CAST(bath AS VARCHAR), '') AS bath,
    CASE WHEN lot_size_sqm IS NULL THEN '' WHEN {k} % 43 = 0 THEN 'abc' ELSE {lot} END AS {names[0]},
    printf('%.1f', street) AS street,
    CASE WHEN {k} % 31 = 0 THEN '' WHEN {k} % 79 = 0 THEN chr(9) || city || chr(9) || ' ' WHEN {k} % 5 = 1 THEN lower(city)
         WHEN {k} % 5 = 2 THEN ' ' || lower(city) || ' ' WHEN {k} % 5 = 3 THEN upper(city)
         ELSE city END AS city,
    CASE WHEN {k} % 3 = 1 THEN lower(state) ELSE state END AS state,
    CASE WHEN {k} % 13 = 0 THEN CAST(zip_code AS VARCHAR) || '.0' ELSE CAST(zip_code AS VARCHAR) END AS zip_code,
    CASE WHEN house_size_sqm IS NULL THEN '' ELSE {house} END AS {names[1]},
    CASE WHEN {k} % 7 = 0 THEN '' WHEN {k} % 19 = 0 THEN 'not a date' WHEN {k} % 23 = 0 THEN '1969-05-01'
         WHEN {k} % 29 = 0 THEN strftime(prev_sold_date, '%Y-%m-%d') || 'T00:00:00+02:00'
         {forms} ELSE strftime(prev_sold_date, '%Y-%m-%d') END AS prev_sold_date
  FROM dup)"""


TOKENS = "('', 'nan', 'NaN', 'None', 'none', 'NA', 'NaT', '<NA>', 'null')"


def tok_sql(e: str) -> str:
    return f"(CASE WHEN {strip_sql(e)} NOT IN {TOKENS} THEN {strip_sql(e)} END)"


def integral_sql(e: str, t: str) -> str:
    d = num_sql(e)
    return f"(CASE WHEN {d} = floor({d}) THEN CAST({d} AS {t}) END)"



def clean_cte(narrow: bool = False) -> str:
    f = (lambda e: f"CAST(CAST({e} AS FLOAT) AS DOUBLE)") if narrow else (lambda e: e)
    return dirty_cte("raw") + f""",
typed AS (
  SELECT src_pos, {f(num_sql('brokered_by'))} AS brokered_by, {tok_sql('status')} AS status,
    {f(num_sql('price'))} AS price, {integral_sql('bed', 'INTEGER')} AS bed,
    {integral_sql('bath', 'INTEGER')} AS bath,
    {f(num_sql('acre_lot') + ' * 4046.8564224')} AS lot_size_sqm, {f(num_sql('street'))} AS street,
    CASE WHEN {tok_sql('city')} IS NOT NULL THEN {title_sql(tok_sql('city'))} END AS city,
    {tok_sql('state')} AS state, {integral_sql('zip_code', 'BIGINT')} AS zip_code,
    {f(num_sql('house_size') + ' * 0.09290304')} AS house_size_sqm,
    CASE WHEN year({ts_sql('prev_sold_date')}) > 1970 THEN {ts_sql('prev_sold_date')} END AS prev_sold_date
  FROM txt),
complete AS (
  SELECT * FROM typed WHERE brokered_by IS NOT NULL AND status IS NOT NULL AND price IS NOT NULL
    AND lot_size_sqm IS NOT NULL AND street IS NOT NULL AND city IS NOT NULL AND state IS NOT NULL
    AND zip_code IS NOT NULL),
clean AS (
  SELECT DISTINCT ON (brokered_by, prev_sold_date, price, street, city, zip_code) *
  FROM complete ORDER BY brokered_by, prev_sold_date, price, street, city, zip_code, src_pos)"""


CLEAN_CTE = clean_cte()

PARSE_CTE = dirty_cte("clean_csv") + f""",
parsed AS (
  SELECT src_pos, {num_sql('brokered_by')} AS brokered_by, trim(status) AS status, {num_sql('price')} AS price,
    {num_sql('lot_size_sqm')} AS lot_size_sqm, {num_sql('street')} AS street,
    {title_sql('city')} AS city, {title_sql('state')} AS state, {strict_int_sql('zip_code')} AS zip_code,
    {strict_int_sql('bed')} AS bed, {strict_int_sql('bath')} AS bath,
    {num_sql('house_size_sqm')} AS house_size_sqm,
    CASE WHEN trim(prev_sold_date) IN ('', 'NaT', 'nan', 'None', 'NaN') THEN NULL
         WHEN year({record_ts_sql('prev_sold_date')}) BETWEEN 1970 AND 2105 THEN {record_ts_sql('prev_sold_date')} END
      AS prev_sold_date
  FROM txt),
checked AS (
  SELECT *, array_to_string(list_filter([
      CASE WHEN brokered_by IS NULL THEN 'brokered_by' END,
      CASE WHEN status IS NULL OR status = '' THEN 'status' END,
      CASE WHEN price IS NULL THEN 'price' END,
      CASE WHEN lot_size_sqm IS NULL THEN 'lot_size_sqm' END,
      CASE WHEN street IS NULL THEN 'street' END,
      CASE WHEN city IS NULL OR city = '' THEN 'city' END,
      CASE WHEN state IS NULL OR state = '' THEN 'state' END,
      CASE WHEN zip_code IS NULL THEN 'zip_code' END], lambda x: x IS NOT NULL), ',') AS reasons
  FROM parsed),
recs AS (
  SELECT src_pos AS listing_id, CAST(brokered_by AS INTEGER) AS brokered_by, status, price, lot_size_sqm,
         street, city, state, zip_code, bed, bath, house_size_sqm, CAST(prev_sold_date AS DATE) AS prev_sold_date
  FROM checked WHERE reasons = '')"""

ORACLE["title_case"] = with_listings(f"""
SELECT src_pos, {title_sql('city')} AS city_title, {title_sql('state')} AS state_title FROM txt""",
                                     dirty_cte("raw"))

ORACLE["null_tokens"] = with_listings(f"""
SELECT src_pos, {tok_sql('status')} AS status, {tok_sql('city')} AS city, {tok_sql('state')} AS state,
       {tok_sql('prev_sold_date')} AS prev_sold_date FROM txt""", dirty_cte("raw"))

ORACLE["unit_conversion"] = with_listings(f"""
SELECT src_pos, {num_sql('acre_lot')} * 4046.8564224 AS lot_size_sqm,
       {num_sql('house_size')} * 0.09290304 AS house_size_sqm FROM txt""", dirty_cte("raw"))

ORACLE["clean_listings"] = with_listings("SELECT * FROM clean", CLEAN_CTE)
ORACLE["clean_listings_narrow"] = with_listings("SELECT * FROM clean", clean_cte(narrow=True))

ORACLE["cleaned_csv_rows"] = with_listings("""
SELECT CAST(src_pos AS VARCHAR) AS src_pos, printf('%.2f', brokered_by) AS brokered_by,
       COALESCE(status, '') AS status, printf('%.2f', price) AS price,
       COALESCE(CAST(bed AS VARCHAR), '') AS bed, COALESCE(CAST(bath AS VARCHAR), '') AS bath,
       COALESCE(printf('%.2f', lot_size_sqm), '') AS lot_size_sqm, printf('%.2f', street) AS street,
       city, state, CAST(zip_code AS VARCHAR) AS zip_code,
       COALESCE(printf('%.2f', house_size_sqm), '') AS house_size_sqm,
       COALESCE(strftime(prev_sold_date, '%Y-%m-%d %H:%M:%S'), '') AS prev_sold_date
FROM clean""", CLEAN_CTE)

ORACLE["dedup_keep_first"] = with_listings("""
SELECT DISTINCT ON (brokered_by, prev_sold_date, price, street, city, zip_code) *
FROM txt ORDER BY brokered_by, prev_sold_date, price, street, city, zip_code, src_pos""", dirty_cte("raw"))

ORACLE["parse_listings"] = with_listings("""
SELECT src_pos, brokered_by, status, price, lot_size_sqm, street, city, state, zip_code, bed, bath,
       house_size_sqm, prev_sold_date FROM checked WHERE reasons = ''""", PARSE_CTE)

ORACLE["validate_required"] = with_listings("""
SELECT src_pos, reasons FROM checked WHERE reasons <> ''""", PARSE_CTE)

# ---------------------------------------------------------------- star layout
HASH1 = "TRY_CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT)"


def hash_sql(*parts: str) -> str:
    return HASH1.format(" || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts))


ORACLE["star_brokers"] = with_listings("SELECT DISTINCT brokered_by FROM L WHERE brokered_by IS NOT NULL")
ORACLE["star_states"] = with_listings(f"""
SELECT {hash_sql('state_name')} AS state_id, state_name
FROM (SELECT DISTINCT state AS state_name FROM L WHERE state IS NOT NULL) s""")
ORACLE["star_cities"] = with_listings(f"""
SELECT {hash_sql('city_name', hash_sql('state_name'))} AS city_id, city_name, {hash_sql('state_name')} AS state_id
FROM (SELECT DISTINCT city AS city_name, state AS state_name FROM L
      WHERE city IS NOT NULL AND state IS NOT NULL) c""")
ORACLE["star_zip_codes"] = with_listings("SELECT DISTINCT zip_code FROM L WHERE zip_code IS NOT NULL")
ORACLE["star_listings"] = with_listings(
    "SELECT listing_id, brokered_by, status, price, prev_sold_date FROM L")
ORACLE["star_estate_details"] = with_listings("""
SELECT listing_id, bed, bath, house_size_sqm AS house_size FROM L
WHERE bed IS NOT NULL OR bath IS NOT NULL OR house_size_sqm IS NOT NULL""")
ORACLE["star_land_data"] = with_listings("""
SELECT listing_id, lot_size_sqm AS area_size_in_square_m FROM L WHERE lot_size_sqm IS NOT NULL""")
ORACLE["star_addresses"] = with_listings(f"""
SELECT listing_id, street, zip_code, {hash_sql('city', hash_sql('state'))} AS city_id FROM L
WHERE street IS NOT NULL AND zip_code IS NOT NULL AND city IS NOT NULL AND state IS NOT NULL""")

ORACLE["resolve_city_ids"] = with_listings(f"""
SELECT listing_id, city, state, {hash_sql('city', hash_sql('state'))} AS city_id FROM L""")

ORACLE["listing_details"] = with_listings("""
SELECT listing_id, brokered_by, status, price, prev_sold_date, bed, bath, house_size_sqm, lot_size_sqm,
       street, zip_code, city, state
FROM L WHERE street IS NOT NULL AND zip_code IS NOT NULL AND city IS NOT NULL AND state IS NOT NULL""")

ORACLE["distinct_on"] = """
SELECT DISTINCT ON (l_orderkey) l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice
FROM lineitem ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice"""

ORACLE["null_safe_match"] = with_listings("""
SELECT l.listing_id, l.brokered_by, l.status, l.price, l.prev_sold_date, r.street, r.zip_code, r.first_id
FROM recs l JOIN (
  SELECT DISTINCT ON (brokered_by, status, price, prev_sold_date)
         brokered_by, status, price, prev_sold_date, street, zip_code, listing_id AS first_id
  FROM recs ORDER BY brokered_by, status, price, prev_sold_date, street, zip_code, listing_id) r
ON l.brokered_by = r.brokered_by AND l.status = r.status AND l.price = r.price
   AND l.prev_sold_date IS NOT DISTINCT FROM r.prev_sold_date""", PARSE_CTE)


# ---------------------------------------------------------------- run telemetry
_METHODS = ", ".join(f"'{m}'" for m in (
    "usecase1_filter_properties", "usecase2_update_prices", "usecase3_add_solar_panels",
    "usecase4_price_analysis", "usecase5_average_price_per_city", "usecase6_filter_by_bedrooms_and_size",
    "usecase7_bulk_import"))
_FILE_RE = r"'^([^_]+)_(\d{2}-\d{2}-\d{4})_Run(\d+)'"

RUNS_CTE = f"""WITH runs AS (
  SELECT event_id AS "index", strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS run_id, event_type AS database,
         [{_METHODS}][user_id % 7 + 1] AS usecase,
         value AS execution_time_s, CAST(trunc(value * 1000) AS BIGINT) AS execution_time_ms,
         value * 1.5 AS avg_cpu_percent, value * 2.0 AS peak_cpu_percent,
         CAST(user_id + 1000 AS DOUBLE) AS avg_mem_mb, CAST(user_id + 1200 AS DOUBLE) AS peak_mem_mb,
         event_type || '_' || strftime(ts, '%d-%m-%Y') || '_Run' || CAST(event_id % 12 + 1 AS VARCHAR) || '.jsonl'
           AS file_name
  FROM events),
meta AS (
  SELECT *, regexp_extract(file_name, {_FILE_RE}, 1) AS file_database,
         CAST(strptime(regexp_extract(file_name, {_FILE_RE}, 2), '%d-%m-%Y') AS DATE) AS run_date,
         TRY_CAST(regexp_extract(file_name, {_FILE_RE}, 3) AS INTEGER) AS run_number
  FROM runs),
recs AS (
  SELECT database, strptime(run_id, '%Y-%m-%dT%H:%M:%S.%f') AS "timestamp",
         TRY_CAST(right(split_part(usecase, '_', 1), 1) AS INTEGER) AS usecase_number,
         regexp_replace(regexp_replace(usecase, '^[^_]*_?', ''), '_', ' ', 'g') AS usecase_name,
         execution_time_s, execution_time_ms, avg_cpu_percent, peak_cpu_percent, avg_mem_mb, peak_mem_mb,
         file_database, run_date, run_number
  FROM meta)
"""

ORACLE["run_file_metadata"] = RUNS_CTE + """
SELECT "index", file_name, file_database, run_date, run_number FROM meta"""
ORACLE["run_records"] = RUNS_CTE + "SELECT * FROM recs"
ORACLE["mean_exec_by_usecase"] = RUNS_CTE + f"""
SELECT usecase_name, database, {rnd('AVG(execution_time_s)', 4)} AS mean_execution_time_s
FROM recs GROUP BY usecase_name, database"""
ORACLE["mean_exec_by_day"] = RUNS_CTE + f"""
SELECT CAST("timestamp" AS DATE) AS date_only, database, {rnd('AVG(execution_time_s)', 4)} AS mean_exec_time_s
FROM recs WHERE usecase_number = 1 GROUP BY 1, 2 ORDER BY 1, 2"""
ORACLE["metric_quartiles"] = RUNS_CTE + f""",
long AS (UNPIVOT (SELECT database, execution_time_s, peak_cpu_percent, avg_mem_mb FROM recs)
         ON execution_time_s, peak_cpu_percent, avg_mem_mb INTO NAME metric VALUE v)
SELECT database, metric, {rnd('MIN(v)', 6)} AS "min", {rnd('quantile_cont(v, 0.25)', 6)} AS q1,
       {rnd('quantile_cont(v, 0.5)', 6)} AS median, {rnd('quantile_cont(v, 0.75)', 6)} AS q3,
       {rnd('MAX(v)', 6)} AS "max"
FROM long GROUP BY database, metric"""
ORACLE["mean_exec_chart"] = RUNS_CTE + f"""
SELECT m.usecase_name, m.database, m.mean_execution_time_s, n.usecase_number,
       CASE n.usecase_number WHEN 1 THEN 'Filtering Query Properties' WHEN 2 THEN 'Bulk Update'
            WHEN 3 THEN 'Schema Evolution' WHEN 4 THEN 'Analytical Query' WHEN 5 THEN 'Aggregation'
            WHEN 6 THEN 'Filtering Query Bedrooms and Size' WHEN 7 THEN 'Bulk Import' END AS label
FROM (SELECT usecase_name, database, {rnd('AVG(execution_time_s)', 4)} AS mean_execution_time_s
      FROM recs GROUP BY 1, 2) m
JOIN (SELECT DISTINCT usecase_name, usecase_number FROM recs) n ON m.usecase_name = n.usecase_name
ORDER BY n.usecase_number, m.database"""
ORACLE["usecase_catalog"] = RUNS_CTE + """
SELECT DISTINCT usecase_number, usecase_name,
       'uc ' || CAST(usecase_number AS VARCHAR) || ': ' ||
       CASE usecase_number WHEN 1 THEN 'Filtering Query Properties' WHEN 2 THEN 'Bulk Update'
            WHEN 3 THEN 'Schema Evolution' WHEN 4 THEN 'Analytical Query' WHEN 5 THEN 'Aggregation'
            WHEN 6 THEN 'Filtering Query Bedrooms and Size' WHEN 7 THEN 'Bulk Import' END AS label
FROM recs ORDER BY usecase_number, usecase_name"""
ORACLE["telemetry_summary"] = f"""
SELECT event_type AS system, CAST(ts AS DATE) AS day,
       {rnd('AVG(value)', 2)} AS avg_cpu, {rnd('MAX(value)', 2)} AS peak_cpu,
       {rnd('AVG(CAST(user_id AS DOUBLE))', 2)} AS avg_mem, {rnd('MAX(CAST(user_id AS DOUBLE))', 2)} AS peak_mem,
       {rnd('(MAX(event_id * 4096) - MIN(event_id * 4096)) / 1048576.0', 2)} AS total_blkio_mb,
       COUNT(*) AS samples
FROM events GROUP BY 1, 2"""
ORACLE["cpu_percent"] = """
WITH s AS (
  SELECT event_id, CAST(round(value * 1000000) AS BIGINT) AS cpu_delta, (user_id % 5) * 10000000 AS sys_delta,
         COALESCE(NULLIF(CASE WHEN user_id % 7 <> 0 THEN CAST(user_id % 4 AS INTEGER) END, 0), 1) AS cpus,
         user_id * 1048576 AS mem_usage, event_id * 512 + user_id * 100 AS blk
  FROM events)
SELECT event_id,
       CASE WHEN sys_delta > 0 AND cpu_delta > 0 THEN (cpu_delta / sys_delta) * cpus * 100.0 ELSE 0.0 END
         AS cpu_percent,
       mem_usage / 1048576.0 AS mem_mb, blk AS blkio_bytes
FROM s"""

# ---------------------------------------------------------------- quality checks
ORACLE["check_status"] = with_listings("""
SELECT status, COUNT(*) AS n_rows FROM recs
WHERE status IS NOT NULL AND status NOT IN ('for_sale', 'ready_to_build', 'sold') GROUP BY status""", PARSE_CTE)
ORACLE["check_not_null"] = with_listings("""
SELECT column_name, n_null FROM (UNPIVOT (
  SELECT COUNT(*) FILTER (WHERE listing_id IS NULL) AS listing_id,
         COUNT(*) FILTER (WHERE brokered_by IS NULL) AS brokered_by,
         COUNT(*) FILTER (WHERE status IS NULL) AS status,
         COUNT(*) FILTER (WHERE price IS NULL) AS price,
         COUNT(*) FILTER (WHERE lot_size_sqm IS NULL) AS lot_size_sqm,
         COUNT(*) FILTER (WHERE street IS NULL) AS street,
         COUNT(*) FILTER (WHERE city IS NULL) AS city,
         COUNT(*) FILTER (WHERE state IS NULL) AS state,
         COUNT(*) FILTER (WHERE zip_code IS NULL) AS zip_code,
         COUNT(*) FILTER (WHERE bed IS NULL) AS bed,
         COUNT(*) FILTER (WHERE bath IS NULL) AS bath,
         COUNT(*) FILTER (WHERE house_size_sqm IS NULL) AS house_size_sqm,
         COUNT(*) FILTER (WHERE prev_sold_date IS NULL) AS prev_sold_date
  FROM recs) ON COLUMNS(*) INTO NAME column_name VALUE n_null)""", PARSE_CTE)
ORACLE["check_orphans"] = """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"""
ORACLE["check_foreign_keys"] = """
SELECT relation, CAST(n AS BIGINT) AS n_orphans FROM (VALUES ('cities.state_id -> states', 0), ('listings.brokered_by -> brokers', 0),
  ('estate_details.listing_id -> listings', 0), ('land_data.listing_id -> listings', 0),
  ('addresses.listing_id -> listings', 0), ('addresses.zip_code -> zip_codes', 0),
  ('addresses.city_id -> cities', 0)) t(relation, n)"""
ORACLE["check_unique"] = with_listings("""
SELECT brokered_by, status, price, prev_sold_date, COUNT(*) AS n_rows FROM recs
GROUP BY brokered_by, status, price, prev_sold_date HAVING COUNT(*) > 1""", PARSE_CTE)

# ---------------------------------------------------------------- copy-on-write changes
_TGT = "prev_sold_date < DATE '1998-01-01'"
_NEW = "prev_sold_date >= DATE '1997-01-01'"
ORACLE["insert_if_absent"] = with_listings(f"""
SELECT {LCOLS} FROM L WHERE {_TGT}
UNION ALL
SELECT {LCOLS} FROM L WHERE {_NEW} AND listing_id NOT IN (SELECT listing_id FROM L WHERE {_TGT})""")
ORACLE["insert_new_count"] = with_listings(f"""
SELECT COUNT(*) AS n_new FROM (SELECT DISTINCT listing_id FROM L WHERE {_NEW}) b
WHERE listing_id NOT IN (SELECT listing_id FROM L WHERE {_TGT})""")
ORACLE["upsert"] = with_listings(f"""
SELECT {LCOLS} FROM L WHERE {_TGT} AND listing_id NOT IN (SELECT listing_id FROM L WHERE {_NEW})
UNION ALL
SELECT listing_id, brokered_by, status,
       CAST(CAST(CAST(price AS DECIMAL(16,2)) * CAST(1.1 AS DECIMAL(7,1)) AS DECIMAL(16,2)) AS DOUBLE) AS price,
       lot_size_sqm, street, city, state, zip_code, bed, bath, house_size_sqm, prev_sold_date
FROM L WHERE {_NEW}""")
ORACLE["schema_add_drop"] = with_listings("""
SELECT listing_id, brokered_by, status, price, lot_size_sqm, street, city, state, zip_code, bed,
       house_size_sqm, prev_sold_date, CAST(NULL AS BOOLEAN) AS solar_panels FROM L""")

# ---------------------------------------------------------------- documents
_DOC = ("listing_id, brokered_by, status, price, prev_sold_date, bed, bath, house_size_sqm AS house_size, "
        "lot_size_sqm AS area_size_in_square_m, street, zip_code, lower(city) AS city, lower(state) AS state")
ORACLE["import_documents"] = with_listings(f"SELECT {_DOC} FROM L")
ORACLE["documents_bedrooms_size"] = with_listings(f"SELECT {_DOC} FROM L WHERE bed > 2 AND house_size_sqm < 150.0")
ORACLE["lookup_unwind"] = with_listings(f"""
SELECT {', '.join('L.' + c.strip() for c in LCOLS.split(','))}, g.n_listings
FROM (SELECT city, state, COUNT(*) AS n_listings FROM L WHERE city IS NOT NULL AND state IS NOT NULL
      GROUP BY city, state HAVING COUNT(*) > 500) g
JOIN L ON L.city = g.city AND L.state = g.state AND L.price IS NOT NULL AND L.price < 250000.0""")


# ---------------------------------------------------------------- streaming
ORACLE["stream_telemetry"] = f"""
SELECT event_type AS system, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS window_start,
       CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY AS window_end,
       {rnd('AVG(value)', 2)} AS avg_cpu, {rnd('MAX(value)', 2)} AS peak_cpu,
       {rnd('AVG(CAST(user_id AS DOUBLE))', 2)} AS avg_mem, {rnd('MAX(CAST(user_id AS DOUBLE))', 2)} AS peak_mem,
       {rnd('(MAX(event_id * 4096) - MIN(event_id * 4096)) / 1048576.0', 2)} AS total_blkio_mb,
       COUNT(*) AS samples
FROM events GROUP BY 1, 2, 3"""
ORACLE["stream_import"] = with_listings("""
SELECT brokered_by, status, price, lot_size_sqm, street, city, state, zip_code, bed, bath, house_size_sqm,
       prev_sold_date FROM recs""", PARSE_CTE)

ORACLE["stream_import_skip"] = with_listings("""
SELECT DISTINCT ON (brokered_by, status, price, prev_sold_date, street, zip_code, city, state)
       brokered_by, status, price, lot_size_sqm, street, city, state, zip_code, bed, bath, house_size_sqm, prev_sold_date
FROM (SELECT 1 AS delivery, * FROM recs WHERE listing_id % 6 < 4
      UNION ALL SELECT 2, * REPLACE (CAST('1' || CAST(bed AS VARCHAR) AS INTEGER) AS bed) FROM recs) d
ORDER BY brokered_by, status, price, prev_sold_date, street, zip_code, city, state, delivery, listing_id""", PARSE_CTE)

ORACLE["top_n_per_broker_ranked"] = ORACLE["top_n_per_broker"]
ORACLE["metric_quartiles_ranked"] = ORACLE["metric_quartiles"]

ORACLE["uc1_sql"] = ORACLE["uc1_filter_properties"]
ORACLE["uc5_sql"] = ORACLE["uc5_avg_price_per_city"]

_JSON_L = ", ".join(f"{c.strip()} := {c.strip()}" for c in LCOLS.split(","))
ORACLE["uc4_json"] = with_listings(f"""
SELECT 'below_threshold' AS part, price_per_sqm AS sort_value, listing_id,
       CAST(to_json(struct_pack({_JSON_L}, price_per_sqm := price_per_sqm)) AS VARCHAR) AS doc
FROM (SELECT *, CAST(price AS DOUBLE) / NULLIF(lot_size_sqm, 0) AS price_per_sqm,
             AVG(CAST(price AS DOUBLE) / NULLIF(lot_size_sqm, 0)) OVER () AS zavg
      FROM L WHERE zip_code = 10500 AND lot_size_sqm > 0 AND price > 0) z
WHERE zavg > 0 AND price_per_sqm < zavg * (1 - 0.10)
UNION ALL
SELECT 'sorted_by_city' AS part, price AS sort_value, listing_id,
       CAST(to_json(struct_pack({_JSON_L})) AS VARCHAR) AS doc
FROM L WHERE lower(trim(city)) = 'nation_7' AND price > 0""")

ORACLE["device_counters"] = """
SELECT event_id, CAST(0 AS INTEGER) AS device_pos, event_id * 512 AS bytes FROM events
UNION ALL SELECT event_id, CAST(1 AS INTEGER), user_id * 100 FROM events
UNION ALL SELECT event_id, CAST(2 AS INTEGER), CAST(NULL AS BIGINT) FROM events"""

ORACLE["runs_jsonl_round_trip"] = RUNS_CTE + """
SELECT "index", run_id, database, database || '-db' AS container, usecase, 'Success' AS status,
       execution_time_s, execution_time_ms FROM runs"""

# ---------------------------------------------------------------- written and read back
ORACLE["raw_csv_clean"] = with_listings("SELECT * EXCLUDE (src_pos) FROM clean", CLEAN_CTE)
_CSV_NUM = ", ".join(f"CAST(printf('%.2f', {c}) AS DOUBLE) AS {c}"
                     for c in ("brokered_by", "price", "lot_size_sqm", "street", "house_size_sqm"))
ORACLE["clean_csv_parse"] = with_listings(f"""
SELECT {_CSV_NUM}, status, {title_sql('city')} AS city, {title_sql('state')} AS state,
       CAST(zip_code AS INTEGER) AS zip_code, bed, bath, prev_sold_date FROM clean""", CLEAN_CTE)
ORACLE["stored_documents_bedrooms_size"] = ORACLE["documents_bedrooms_size"]
ORACLE["stored_star_details"] = ORACLE["listing_details"]
ORACLE["stored_star_counts"] = with_listings("""
SELECT 'brokers' AS table_name, COUNT(DISTINCT brokered_by) AS n_rows FROM L
UNION ALL SELECT 'states', COUNT(DISTINCT state) FROM L
UNION ALL SELECT 'cities', COUNT(*) FROM (SELECT DISTINCT city, state FROM L WHERE city IS NOT NULL AND state IS NOT NULL) c
UNION ALL SELECT 'zip_codes', COUNT(DISTINCT zip_code) FROM L
UNION ALL SELECT 'listings', COUNT(*) FROM L
UNION ALL SELECT 'estate_details', COUNT(*) FROM L
          WHERE bed IS NOT NULL OR bath IS NOT NULL OR house_size_sqm IS NOT NULL
UNION ALL SELECT 'land_data', COUNT(lot_size_sqm) FROM L
UNION ALL SELECT 'addresses', COUNT(*) FROM L
          WHERE street IS NOT NULL AND zip_code IS NOT NULL AND city IS NOT NULL AND state IS NOT NULL""")
ORACLE["check_unique_keys"] = with_listings("""
SELECT unique_key, CAST(n AS BIGINT) AS n_repeated FROM (VALUES ('brokers(brokered_by)', 0), ('states(state_id)', 0),
  ('states(state_name)', 0), ('cities(city_id)', 0), ('cities(city_name, state_id)', 0), ('zip_codes(zip_code)', 0),
  ('listings(listing_id)', (SELECT COUNT(*) FROM (SELECT 1 FROM L GROUP BY listing_id HAVING COUNT(*) > 1) d)),
  ('estate_details(listing_id)', 0), ('land_data(listing_id)', 0), ('addresses(listing_id)', 0)) t(unique_key, n)""")
ORACLE["engine_import"] = ORACLE["stream_import"]
ORACLE["engine_uc2_uc3"] = with_listings("""
SELECT brokered_by, status,
       CASE WHEN brokered_by = 605
            THEN CAST(CAST(CAST(price AS DECIMAL(16,2)) * CAST(1.05 AS DECIMAL(8,2)) AS DECIMAL(16,2)) AS DOUBLE)
            ELSE price END AS price,
       lot_size_sqm, street, city, state, zip_code, bed, bath, house_size_sqm, prev_sold_date, TRUE AS has_flag
FROM recs""", PARSE_CTE)
_some = "event_id % 10 <> 0"
ORACLE["run_sample_summaries"] = f"""
SELECT event_id AS "index",
       CASE WHEN {_some} THEN {rnd('(value + value * 2 + value * 3) / 3', 2)} ELSE 0 END AS avg_cpu,
       CASE WHEN {_some} THEN {rnd('value * 3', 2)} ELSE 0 END AS peak_cpu,
       CASE WHEN {_some} THEN {rnd('CAST(user_id + 8 AS DOUBLE)', 2)} ELSE 0 END AS avg_mem,
       CASE WHEN {_some} THEN {rnd('CAST(user_id + 16 AS DOUBLE)', 2)} ELSE 0 END AS peak_mem,
       CASE WHEN {_some} THEN 2.0::DOUBLE ELSE 0 END AS total_blkio_mb,
       CASE WHEN {_some} THEN 3::BIGINT ELSE 0 END AS n_samples
FROM events"""
ORACLE["runs_by_timestamp"] = RUNS_CTE + 'SELECT * FROM recs ORDER BY "timestamp", database, usecase_number'

# ---------------------------------------------------------------- loads into a star
def _batch_sql(where: str, n: int, changed: bool) -> str:
    price = ("CAST(CAST(CAST(price AS DECIMAL(16,2)) * CAST(1.10 AS DECIMAL(8,2)) AS DECIMAL(16,2)) AS DOUBLE)"
             if changed else "price")
    return (f"SELECT * REPLACE (CASE WHEN listing_id % {n} = 0 THEN 'withdrawn' ELSE status END AS status, "
            f"{price} AS price, {'CAST(bed + 1 AS INTEGER)' if changed else 'bed'} AS bed) FROM L WHERE {where}")


_KNOWN = "status IN ('for_sale', 'ready_to_build', 'sold')"
_LOADS_CTE = f"""
b1 AS ({_batch_sql('zip_code < 11800', 97, False)}),
b2 AS ({_batch_sql('zip_code >= 11200', 89, True)}),
v1 AS (SELECT * FROM b1 WHERE {_KNOWN}),
v2 AS (SELECT * FROM b2 WHERE {_KNOWN}),
s1 AS (SELECT state, row_number() OVER (ORDER BY state) AS state_id FROM (SELECT DISTINCT state FROM v1)),
s2 AS (SELECT state, (SELECT count(*) FROM s1) + row_number() OVER (ORDER BY state) AS state_id
       FROM (SELECT DISTINCT state FROM v2 WHERE state NOT IN (SELECT state FROM s1))),
s AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2),
c1 AS (SELECT city, state_id, row_number() OVER (ORDER BY city, state_id) AS city_id
       FROM (SELECT DISTINCT city, state_id FROM v1 JOIN s USING (state))),
c2 AS (SELECT city, state_id, (SELECT count(*) FROM c1) + row_number() OVER (ORDER BY city, state_id) AS city_id
       FROM (SELECT DISTINCT city, state_id FROM v2 JOIN s USING (state)
             WHERE (city, state_id) NOT IN (SELECT city, state_id FROM c1))),
c AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2),
kept AS (SELECT * FROM v1 UNION ALL SELECT * FROM v2 WHERE listing_id NOT IN (SELECT listing_id FROM v1)),
e1 AS (SELECT * FROM v1 WHERE bed IS NOT NULL OR bath IS NOT NULL OR house_size_sqm IS NOT NULL),
e2 AS (SELECT * FROM v2 WHERE bed IS NOT NULL OR bath IS NOT NULL OR house_size_sqm IS NOT NULL),
e AS (SELECT * FROM e2 UNION ALL SELECT * FROM e1 WHERE listing_id NOT IN (SELECT listing_id FROM e2)),
d AS (SELECT * FROM v2 WHERE lot_size_sqm IS NOT NULL UNION ALL SELECT * FROM v1
      WHERE lot_size_sqm IS NOT NULL AND listing_id NOT IN (SELECT listing_id FROM v2 WHERE lot_size_sqm IS NOT NULL))"""

ORACLE["star_incremental_load"] = with_listings("""
SELECT k.listing_id, k.brokered_by, k.status, k.price, k.prev_sold_date, e.bed, e.bath, e.house_size_sqm,
       d.lot_size_sqm, k.street, k.zip_code, k.city, k.state, c.city_id, s.state_id
FROM kept k JOIN s ON s.state = k.state JOIN c ON c.city = k.city AND c.state_id = s.state_id
LEFT JOIN e ON e.listing_id = k.listing_id LEFT JOIN d ON d.listing_id = k.listing_id""", _LOADS_CTE)

ORACLE["star_load_counts"] = with_listings("""
SELECT CAST(1 AS BIGINT) AS load, (SELECT count(*) FROM b1) AS n_rows,
       (SELECT count(*) FROM b1) - (SELECT count(*) FROM v1) AS n_quarantined, (SELECT count(*) FROM v1) AS n_new,
       CAST(0 AS BIGINT) AS n_updated, (SELECT count(*) FROM b1 WHERE status = 'withdrawn') AS n_bad_status
UNION ALL
SELECT 2, (SELECT count(*) FROM b2), (SELECT count(*) FROM b2) - (SELECT count(*) FROM v2),
       (SELECT count(*) FROM v2 WHERE listing_id NOT IN (SELECT listing_id FROM v1)),
       (SELECT count(*) FROM e2 WHERE bed IS NOT NULL AND listing_id IN (SELECT listing_id FROM e1)),
       (SELECT count(*) FROM b2 WHERE status = 'withdrawn')
UNION ALL
SELECT 3, (SELECT count(*) FROM b2), (SELECT count(*) FROM b2) - (SELECT count(*) FROM v2), 0, 0,
       (SELECT count(*) FROM b2 WHERE status = 'withdrawn')""", _LOADS_CTE)


# ---------------------------------------------------------------- imports that account for every line
ORACLE["uc2_stored"] = ORACLE["uc2_update_prices"].replace(",\n       t.listing_id IS NOT NULL AS updated", "")
ORACLE["uc3_stored"] = ORACLE["uc3_solar_panels"]
ORACLE["reset_and_import"] = with_listings("""
SELECT 'import' AS step, count(*) AS n_rows, max(listing_id) AS top_id FROM L
UNION ALL SELECT 'reset', 0, NULL UNION ALL SELECT 'again', count(*), max(listing_id) FROM L""")

_NAMES = ("brokered_by", "status", "price", "bed", "bath", "lot_size_sqm", "street", "city", "state", "zip_code",
          "house_size_sqm", "prev_sold_date")
_LINE = " || ',' || ".join(_NAMES)
_SHORT = " || ',' || ".join(_NAMES[:4])
_LINES_CTE = PARSE_CTE + f""",
lines AS (
  SELECT src_pos, row_number() OVER (ORDER BY src_pos) + 1 AS line, src_pos // 2 % 109 = 0 AS blank,
    CASE WHEN src_pos // 2 % 107 = 0 THEN '"' || {_LINE} WHEN src_pos // 2 % 103 = 0 THEN {_LINE} || ',x,y'
         WHEN src_pos // 2 % 101 = 0 THEN {_SHORT} END AS broken, {_LINE} AS whole
  FROM txt),
good AS (SELECT recs.*, line FROM recs JOIN lines ON src_pos = listing_id WHERE NOT blank AND broken IS NULL),
bad AS (SELECT line, CASE WHEN broken IS NULL THEN reasons ELSE 'malformed' END AS reasons, coalesce(broken, whole) AS line_text
        FROM lines JOIN checked USING (src_pos) WHERE NOT blank AND (broken IS NOT NULL OR reasons <> ''))"""
ORACLE["import_interleaved"] = ORACLE["listings"]
ORACLE["import_wide"] = with_listings("SELECT * EXCLUDE (listing_id) FROM good", _LINES_CTE)
ORACLE["import_rejects"] = with_listings("SELECT * FROM bad", _LINES_CTE)
ORACLE["import_counts"] = with_listings("""
SELECT CAST(n AS INTEGER) AS import_no, (SELECT count(*) FROM good) AS imported, (SELECT count(*) FROM bad) AS rejected,
       (SELECT 1 + count(*) FROM lines WHERE blank) AS skipped,
       CASE n WHEN 1 THEN (SELECT count(*) FROM (SELECT DISTINCT brokered_by, status, price, prev_sold_date, street, zip_code,
                                                 city, state FROM good)) ELSE 0 END AS stored
FROM (VALUES (1), (2)) t(n)""", _LINES_CTE)

ORACLE["runs_jsonl_rejects"] = RUNS_CTE + """
SELECT CASE WHEN "index" % 50 <> 7 THEN "index" END AS "index", "index" % 50 = 7 AS malformed,
       CASE WHEN "index" % 50 <> 7 THEN run_id END AS run_id,
       CASE WHEN "index" % 50 = 7 THEN '{"index": ' || "index" END AS line_text FROM runs"""
