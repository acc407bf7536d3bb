from datetime import datetime

from pyspark.sql import functions as F

from tamarisk.functions import cleaning as C
from tamarisk.functions import numeric, privacy
from tamarisk.operators import silver


def column(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", f("x").alias("y")).orderBy("i").collect()]


def test_yes_no(spark):
    values = [" YES ", "ہاں", "نہیں", "2", "0.5", "nan", "inf", "maybe", None, ""]
    assert column(spark, C.yes_no, values) == [1, 1, 0, 1, 0, None, None, None, None, None]
    assert column(spark, lambda c: C.yes_no(c, permissive=True), ["Haan", "Nahi", "2", "x"]) == [1, 0, 2, None]


def test_district(spark):
    values = ["Lahor", "LAHORE", "لاہور", "D.I. Khan", "MirpurKhas", "R.Y.Khan", "Khan", "  ", "", None, "somewhere ELSE", "\tKarachi\n"]
    expected = ["Lahore", "Lahore", "Lahore", "Dera Ismail Khan", "Mirpur Khas", "R.Y.Khan", "Rahim Yar Khan", None, None, None, "Somewhere Else", "Karachi"]
    assert column(spark, C.district, values) == expected


def test_labels(spark):
    assert column(spark, C.water_source, ["پائپ", " WELL ", None]) == ["piped", "well", None]
    assert column(spark, C.ses_tier, ["کم", "Middle"]) == ["low", "middle"]
    assert column(spark, C.legacy_ses_tier, ["Poor", "RICH", "medium", None]) == ["low", "high", "middle", None]
    assert column(spark, C.legacy_water_source, ["Tap", "borehole", "river"]) == ["piped", "handpump", "river"]


def test_dates(spark):
    values = ["2022-03-09", "09/03/2022", "12/25/2021", "25.12.2021", "9/3/2022", "2022/03/09", "unknown", "", None]
    day = datetime(2022, 3, 9)
    assert column(spark, C.parse_date, values) == [day, day, datetime(2021, 12, 25), datetime(2021, 12, 25), day, day, None, None, None]


def test_enumerator(spark):
    assert column(spark, C.enumerator_id, ["e001", "ENU001", "E009 ", "ENUM001", "001", "e12345", "E0", None]) == [
        "E001", "E001", "E009", "ENUM001", "001", "E12345", "E000", None,
    ]


def test_gps(spark):
    rows = spark.createDataFrame([(31.5, 74.3), (0.0, 0.0), (31.5, None), (None, 200.0)], "gps_latitude double, gps_longitude double")
    assert [tuple(r) for r in silver.gps_bounds(rows).collect()] == [(31.5, 74.3), (None, None), (None, None), (None, 200.0)]


def test_bins(spark):
    assert column(spark, C.child_age_group, [-1.0, 0.0, 5.0, 5.5, 59.0, 60.0, None], "double") == [None, "0-5m", "0-5m", "6-11m", "36-59m", None, None]
    assert column(spark, C.maternal_age_group, [14.0, 15.0, 49.0, 50.0], "double") == [None, "15-19", "35-49", None]


def test_numbers(spark):
    assert column(spark, numeric.to_double, ["1.5", "nan", "x", None]) == [1.5, None, None, None]
    assert column(spark, lambda c: numeric.clamped(c, 0.0, 100.0), [-5.0, 50.0, 200.0, None], "double") == [0.0, 50.0, 100.0, None]
    assert column(spark, lambda c: numeric.null_outside(c, 1, 3), [0.0, 1.0, 3.0, 4.0, None], "double") == [None, 1.0, 3.0, None, None]
    assert column(spark, C.muac_mm, ["13.5", "135", None]) == [135.0, 135.0, None]


def test_privacy(spark):
    out = column(spark, lambda c: privacy.pseudonym(c, "s"), ["Amna", "Amna", "", None])
    assert out[0] == out[1] and out[0].startswith("ID_") and len(out[0]) == 11
    assert out[2:] == ["UNKNOWN", "UNKNOWN"]
    assert column(spark, privacy.age_band, [27, 25, None], "int") == ["25-29", "25-29", None]


def test_household_job(spark):
    rows = [
        ("1", "lahor", "2024-01-01 10:00:00", "yes", "200", "999"), ("1", "multan", "2024-01-02 10:00:00", "yes", "5", "30"), ("1", "queta", "bad", "yes", "5", "30"),
        (None, "Lahore", "2024-01-01 10:00:00", "yes", "5", "30"), ("2", "Lahore", "2024-01-01 10:00:00", "no", "5", "30"), ("3", None, None, None, None, None),
    ]
    raw = spark.createDataFrame(rows, "` Household ID` string, district string, submission_time string, consent_given string, household_size string, respondent_age string")
    out = silver.clean_households(raw).collect()
    assert [(r["household_id"], r["district"], r["province"], r["household_size"]) for r in out] == [("1", "Multan", "Punjab", 5.0)]


def test_visit_job_limits(spark):
    rows = [("1", "child", "200", "6", "20"), ("2", "maternal", "200", "6.01", "5"), ("3", "child", "100", None, None), ("3", "child", "100", None, None)]
    raw = spark.createDataFrame(rows, "visit_id string, record_type string, height_cm string, haz_score string, maternal_age string").withColumn("household_id", F.lit("h"))
    out = {r["visit_id"]: r for r in silver.clean_visits(raw).collect()}
    assert len(out) == 3
    assert out["1"]["height_cm"] is None and out["1"]["haz_score"] == 6.0
    assert out["2"]["height_cm"] == 200.0 and out["2"]["haz_score"] is None and out["2"]["maternal_age"] is None


def test_generic_job_renames_once(spark):
    registry = spark.createDataFrame([("ENUM001", "E001", "F")], "old_enum_id string, new_enum_id string, gender string")
    assert silver.clean_generic(registry).columns == ["legacy_enum_id", "enumerator_id", "sex"]
    child = spark.createDataFrame([("r", 13.5, "M")], "child_record_no string, muac_cm double, sex string")
    assert silver.clean_generic(child).collect()[0].asDict() == {"record_id": "r", "muac_mm": 135.0, "child_sex": "M"}


def test_empty_table(spark):
    raw = spark.createDataFrame([], "household_id string, district string, consent_given string")
    assert silver.clean_households(raw).count() == 0
