"""Cleaner and record-parser edge cases (FIXTURES sections 1 and 2)."""
import datetime as dt

from pyspark.sql import functions as F

from domus.functions.text import title_case
from domus.operators import cleaning as cl
from domus.schema import CLEAN_CSV, RAW_LISTING


def clean_csv_rows(spark, rows):
    cols = ["src_pos"] + CLEAN_CSV.fieldNames()
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], cols)


BASE = dict(brokered_by="7.0", status="for_sale", price="100.00", bed="3", bath="2", lot_size_sqm="10.5",
            street="1.0", city="alpha", state="x", zip_code="10001", house_size_sqm="80.5",
            prev_sold_date="2020-01-01")


def row(**kw):
    d = dict(BASE, **kw)
    return tuple(d[c] for c in CLEAN_CSV.fieldNames())


def test_title_case_matches_python(spark):
    words = [" winston-salem ", "o'fallon", "new YORK", "1st street", "NATION_7", "", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(title_case("w")).collect()]
    want = [w.strip().title() if w is not None else None for w in words]
    assert got == want


def test_parser_cases(spark):
    rows = [
        row(bed="3.0"),                                   # 0 bed null, kept
        row(zip_code="601.0"),                            # 1 rejected: zip_code
        row(city="  "),                                   # 2 rejected: city
        row(price="nan"),                                 # 3 rejected: price
        row(prev_sold_date="2106-01-01"),                 # 4 date null
        row(prev_sold_date="1970-06-01"),                 # 5 kept
        row(prev_sold_date="2020-01-01T00:00:00+02:00"),  # 6 -> 2019-12-31 22:00
        row(state="new YORK", city="o'fallon"),           # 7 title case
        row(price="", city=""),                           # 8 both reasons
        row(prev_sold_date="NaT"),                        # 9 null token
        row(zip_code=" 12 "),                             # 10 int with spaces ok
    ]
    valid, rejects = cl.parse_listings(clean_csv_rows(spark, rows))
    v = {r["src_pos"]: r for r in valid.collect()}
    rj = {r["src_pos"]: r["reasons"] for r in rejects.collect()}
    assert rj == {1: "zip_code", 2: "city", 3: "price", 8: "price,city"}
    assert v[0]["bed"] is None and v[0]["bath"] == 2
    assert v[4]["prev_sold_date"] is None
    assert v[5]["prev_sold_date"] == dt.datetime(1970, 6, 1)
    assert v[6]["prev_sold_date"] == dt.datetime(2019, 12, 31, 22, 0)
    assert (v[7]["city"], v[7]["state"]) == ("O'Fallon", "New York")
    assert v[9]["prev_sold_date"] is None
    assert v[10]["zip_code"] == 12
    assert len(v) + len(rj) == len(rows)


def raw_rows(spark, rows, cols=None):
    cols = cols or RAW_LISTING.fieldNames()
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["src_pos"] + list(cols))


RAW = dict(brokered_by="7.0", status="for_sale", price="100", bed="3", bath="2", acre_lot="1.0", street="5.0",
           city="alpha", state="X", zip_code="10001", house_size="1000", prev_sold_date="2020-01-01")


def raw(**kw):
    d = dict(RAW, **kw)
    return tuple(d[c] for c in RAW_LISTING.fieldNames())


def test_cleaner_cases(spark):
    rows = [
        raw(city=""),                                  # 0 dropped (blank city)
        raw(status="nan", street="6"),                 # 1 dropped (null token)
        raw(acre_lot="abc", street="7"),               # 2 dropped (lot required)
        raw(prev_sold_date="1969-05-01", street="8"),  # 3 date -> null
        raw(prev_sold_date="1970-01-01", street="9"),  # 4 date -> null (<= 1970)
        raw(prev_sold_date="not a date", street="10"), # 5 date -> null
        raw(prev_sold_date="2020-01-01T00:00:00+02:00", street="11"),  # 6 -> UTC
        raw(street="12", bed="2"),                     # 7 first of a duplicate pair
        raw(street="12", bed="4"),                     # 8 duplicate -> dropped
        raw(street="13", prev_sold_date="", bed="1"),  # 9 first of a pair with null dates
        raw(street="13", prev_sold_date="", bed="5"),  # 10 dropped
        raw(street="14", city=" winston-salem ", bed="3.0"),  # 11 title case, bed 3
    ]
    out = {r["src_pos"]: r for r in cl.clean_raw(raw_rows(spark, rows)).collect()}
    assert sorted(out) == [3, 4, 5, 6, 7, 9, 11]
    assert out[3]["prev_sold_date"] is None and out[4]["prev_sold_date"] is None
    assert out[5]["prev_sold_date"] is None
    assert out[6]["prev_sold_date"] == dt.datetime(2019, 12, 31, 22, 0)
    assert out[7]["bed"] == 2 and out[9]["bed"] == 1
    assert out[11]["city"] == "Winston-Salem" and out[11]["bed"] == 3
    assert abs(out[7]["lot_size_sqm"] - 4046.8564224) < 1e-9
    assert abs(out[7]["house_size_sqm"] - 92.90304) < 1e-9


def test_cleaner_missing_column_and_narrowing(spark):
    cols = [c for c in RAW_LISTING.fieldNames() if c != "house_size"]
    r = tuple(RAW[c] for c in cols)
    big = tuple(("16777217" if c == "price" else RAW[c]) for c in cols)
    df = raw_rows(spark, [r, big], cols)
    out = cl.clean_raw(df).orderBy("src_pos").collect()
    assert out[0]["house_size_sqm"] is None
    narrowed = cl.clean_raw(df, narrow=True).orderBy("src_pos").collect()
    assert narrowed[1]["price"] == 16777216.0 and out[1]["price"] == 16777217.0


def test_clean_csv_format(spark):
    rows = [raw(street="1", bed="")]
    txt = cl.format_clean_csv(cl.clean_raw(raw_rows(spark, rows)).drop("src_pos")).collect()[0]
    assert txt["price"] == "100.00" and txt["bed"] == "" and txt["prev_sold_date"] == "2020-01-01 00:00:00"


def test_csv_round_trip(spark, tmpdir_path):
    from domus.sinks.writers import write_clean_csv
    from domus.sources.files import read_clean_csv
    rows = [raw(street=str(i)) for i in range(5)]
    clean = cl.clean_raw(raw_rows(spark, rows)).drop("src_pos")
    write_clean_csv(clean, f"{tmpdir_path}/csv")
    text = read_clean_csv(spark, f"{tmpdir_path}/csv")
    valid, rejects = cl.parse_listings(text)
    assert valid.count() == 5 and rejects.count() == 0


def test_raw_csv_file_path_equals_derived_clean(spark, tmpdir_path):
    """S2 from files: keep-first by file order gives the same rows as by source position."""
    from domus.sources.derived import raw_listings_text
    from domus.sources.files import FILE_ORDER, read_raw_csv
    raw = raw_listings_text(spark, "/root/testdata/sf0.001")
    # one file, rows in source order
    raw.orderBy("src_pos").drop("src_pos").coalesce(1).write.option("header", True).csv(f"{tmpdir_path}/raw")
    from_files = cl.clean_raw(read_raw_csv(spark, f"{tmpdir_path}/raw"), order_cols=FILE_ORDER) \
        .drop(*FILE_ORDER)
    derived = cl.clean_raw(raw).drop("src_pos")
    assert from_files.count() == derived.count()
    assert from_files.exceptAll(derived).count() == 0


def test_parsing_survives_any_row(spark):
    rows = [("99999999999.0", "2020-05-01", "miami"), ("12d", "20200101", "\tmiami\n"), ("7.0", "2020-05", "miami"),
            ("0x1p3", "2020", "\u00a0x y\u00a0"), (" 8 ", "2020-1-1", "a")]
    text = spark.createDataFrame([(i, b, "for_sale", "1.5f" if i == 4 else "10", "5", "1", c, "fl", "33101", "1", "1", "2", d)
                                  for i, (b, d, c) in enumerate(rows)],
                                 "src_pos long, brokered_by string, status string, price string, lot_size_sqm string, street string, "
                                 "city string, state string, zip_code string, bed string, bath string, house_size_sqm string, "
                                 "prev_sold_date string")
    got = {r["src_pos"]: r for r in cl.parse_listings_with_reasons(text).collect()}
    assert [got[i]["reasons"] for i in range(5)] == [["brokered_by"], ["brokered_by"], [], ["brokered_by"], ["price"]]
    assert [str(got[i]["prev_sold_date"])[:10] for i in range(5)] == ["2020-05-01", "2020-01-01", "None", "None", "None"]
    assert got[1]["city"] == "Miami" and got[3]["city"] == "X Y"
    valid, _ = cl.parse_listings(text)
    assert [r["listing_id"] for r in cl.to_wide_listing(valid).collect()] == [2]


def test_absent_mandatory_column_drops_no_row(spark):
    from domus.sources.derived import raw_listings_text
    raw = raw_listings_text(spark, "/root/testdata/sf0.001").drop("status")
    assert cl.clean_raw(raw).count() > 0


def test_price_factor_is_exact(spark):
    from domus.functions.measures import adjust_price
    df = spark.createDataFrame([(10.0,)], "price double")
    assert df.select(adjust_price(1e7).alias("p")).first()["p"] == 100000010.0
    assert df.select(adjust_price(-0.005).alias("p")).first()["p"] == 9.95


def test_sizes_are_chosen_for_a_local_master_only():
    from domus.session import settings_for
    assert "spark.sql.shuffle.partitions" not in settings_for("spark://host:7077", {})
    assert "spark.driver.memory" not in settings_for("yarn", {})
    assert settings_for("local[8]", {})["spark.sql.shuffle.partitions"] == "8"
    assert "spark.driver.memory" not in settings_for("local[8]", {"spark.driver.memory": "4g"})


def _filters(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Filter " in line]


def test_fields_are_worked_out_once(spark):
    """No filter asks for parsed fields by parsing them again below the projections."""
    raw = spark.createDataFrame([(0, *["1"] * len(RAW_LISTING.fields))], ["src_pos", *RAW_LISTING.fieldNames()])
    valid, rejects = cl.parse_listings(clean_csv_rows(spark, [row()]))
    for df in (cl.clean_raw(raw), valid, rejects):
        assert not [f for f in _filters(df) if "RLIKE" in f or "btrim" in f.lower() or "regexp" in f]


def test_first_complete_row_of_a_group_stays(spark):
    """A row without a mandatory field is dropped before the first of its group is taken."""
    names = ["src_pos", *RAW_LISTING.fieldNames()]
    base = dict(brokered_by="7", status="sold", price="10", bed="1", bath="1", acre_lot="2", street="5", city="rome", state="x",
                zip_code="100", house_size="50", prev_sold_date="2020-01-01")
    rows = [dict(base, src_pos=0, status="nan"), dict(base, src_pos=1, bed="2"), dict(base, src_pos=2, bed="3"),
            dict(base, src_pos=3, price="11", acre_lot="abc")]
    raw = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], names)
    assert [(r.src_pos, r.bed, r.city) for r in cl.clean_raw(raw).collect()] == [(1, 2, "Rome")]


def test_strip_takes_all_white_space(spark):
    from domus.functions.text import strip
    texts = ["a", "", None, " \t x  ", "　", "a b", "é ", "\x1c7\x1f", "​z", "~"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(strip(F.col("t"))).collect()]
    assert got == ["a", "", None, "x", "", "a b", "é", "7", "​z", "~"]
