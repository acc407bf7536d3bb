"""Reference data of the survey: districts, spelling variants, label maps, header names.

The values below are fixed by the survey itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed values: (district, province, latitude, longitude, urban), in matching order.
DISTRICTS = (
    ("Lahore", "Punjab", 31.5497, 74.3436, True), ("Faisalabad", "Punjab", 31.4180, 73.0790, True),
    ("Multan", "Punjab", 30.1575, 71.5249, True), ("Rawalpindi", "Punjab", 33.6007, 73.0679, True),
    ("Gujranwala", "Punjab", 32.1877, 74.1945, False), ("Sialkot", "Punjab", 32.4945, 74.5229, False),
    ("Bahawalpur", "Punjab", 29.3956, 71.6836, False), ("Sargodha", "Punjab", 32.0836, 72.6711, False),
    ("Rahim Yar Khan", "Punjab", 28.4202, 70.2952, False),
    ("Karachi", "Sindh", 24.8607, 67.0011, True), ("Hyderabad", "Sindh", 25.3960, 68.3578, True),
    ("Sukkur", "Sindh", 27.7052, 68.8574, False), ("Larkana", "Sindh", 27.5570, 68.2247, False),
    ("Mirpur Khas", "Sindh", 25.5270, 69.0138, False), ("Nawabshah", "Sindh", 26.2442, 68.4100, False),
    ("Jacobabad", "Sindh", 28.2769, 68.4514, False), ("Dadu", "Sindh", 26.7319, 67.7750, False),
    ("Tharparkar", "Sindh", 24.7161, 70.2430, False),
    ("Peshawar", "KPK", 34.0151, 71.5249, True), ("Mardan", "KPK", 34.1986, 72.0404, False),
    ("Abbottabad", "KPK", 34.1463, 73.2117, False), ("Swat", "KPK", 35.2227, 72.4258, False),
    ("Kohat", "KPK", 33.5869, 71.4414, False), ("Bannu", "KPK", 32.9892, 70.6060, False),
    ("Dera Ismail Khan", "KPK", 31.8314, 70.9019, False), ("Mansehra", "KPK", 34.3330, 73.2000, False),
    ("Charsadda", "KPK", 34.1480, 71.7308, False),
    ("Quetta", "Balochistan", 30.1798, 66.9750, True), ("Turbat", "Balochistan", 26.0022, 63.0440, False),
    ("Khuzdar", "Balochistan", 27.8120, 66.6170, False), ("Gwadar", "Balochistan", 25.1264, 62.3225, False),
    ("Chaman", "Balochistan", 30.9200, 66.4500, False), ("Zhob", "Balochistan", 31.3416, 69.4481, False),
    ("Loralai", "Balochistan", 30.3700, 68.5900, False), ("Sibi", "Balochistan", 29.5430, 67.8770, False),
    ("Nushki", "Balochistan", 29.5520, 66.0200, False),
)

#: Spellings and Urdu names of districts (lower case).
DISTRICT_VARIANTS = {
    "lahor": "Lahore", "لاہور": "Lahore", "کراچی": "Karachi", "فیصل آباد": "Faisalabad", "ملتان": "Multan",
    "راولپنڈی": "Rawalpindi", "peshawer": "Peshawar", "پشاور": "Peshawar", "queta": "Quetta", "کوئٹہ": "Quetta",
    "hydrabad": "Hyderabad", "حیدرآباد": "Hyderabad", "sukkar": "Sukkur", "سکھر": "Sukkur", "سوات": "Swat",
    "gawadar": "Gwadar", "گوادر": "Gwadar", "ryk": "Rahim Yar Khan", "d.i. khan": "Dera Ismail Khan",
    "dikhan": "Dera Ismail Khan", "di khan": "Dera Ismail Khan", "d.i.khan": "Dera Ismail Khan",
    "d i khan": "Dera Ismail Khan", "mirpurkhas": "Mirpur Khas", "mirpur-khas": "Mirpur Khas",
}

#: Urdu labels of water sources and of socio-economic tiers.
WATER_URDU = {"پائپ": "piped", "ہینڈ پمپ": "handpump", "کنواں": "well", "ٹینکر": "tanker", "دریا": "river", "نہر": "canal"}
SES_URDU = {"کم": "low", "درمیانہ": "middle", "زیادہ": "high"}
#: Labels of the historical surveys.
WATER_LEGACY = {"tap": "piped", "pump": "handpump", "borehole": "handpump"}
SES_LEGACY = {"poor": "low", "rich": "high", "medium": "middle"}
#: Words for yes and no.
YES = ("1", "yes", "y", "true", "t", "ok", "ہاں")
NO = ("0", "no", "n", "false", "f", "نہیں")
YES_MORE, NO_MORE = ("haan",), ("nahi",)
#: Urdu words that mark a bilingual value (fixed values).
URDU_WORDS = ("پائپ", "ہینڈ", "کنواں", "کم", "درمیانہ", "زیادہ")

#: Header names of the historical surveys and their present names.
LEGACY_HEADERS = {
    "hh_id": "household_id", "district_name": "district", "tehsil": "union_council", "respondent": "respondent_name",
    "age_years": "respondent_age", "hh_size": "household_size", "children_u5": "children_under_5",
    "women_repro_age": "women_15_49", "ses": "ses_tier", "water": "water_source", "latrine": "has_toilet",
    "consent": "consent_given", "date_enrolled": "enrollment_date", "gps_lat": "gps_latitude", "gps_long": "gps_longitude",
    "enumerator_code": "enumerator_id",
    "location.district": "district", "location.uc": "union_council", "location.province": "province",
    "respondent.name": "respondent_name", "respondent.age": "respondent_age", "household.size": "household_size",
    "household.children_u5": "children_under_5", "household.women_15_49": "women_15_49", "socioeconomic.tier": "ses_tier",
    "water.source": "water_source", "sanitation.toilet": "has_toilet", "consent.obtained": "consent_given",
    "survey.date": "enrollment_date", "gps.latitude": "gps_latitude", "gps.longitude": "gps_longitude",
    "child_record_no": "record_id", "household_ref": "household_id", "age_months": "child_age_months", "sex": "child_sex",
    "haz": "haz_score", "waz": "waz_score", "whz": "whz_score", "stunted_flag": "stunted", "wasted_flag": "wasted",
    "underweight_flag": "underweight", "anaemia": "anemia", "diarrhoea_2wk": "diarrhea_2w", "vaccinated": "vaccination_full",
    "muac_cm": "muac_mm",
    "mat_id": "record_id", "hh_ref": "household_id", "mother_age": "maternal_age", "anc_visits_4plus": "anc_4plus",
    "skilled_birth_attendant": "last_delivery_skilled", "anaemia_status": "anemia", "hb_level": "hemoglobin_gdl",
    "orgUnit": "facility_id", "orgUnitName": "facility_name", "facilityLevel": "facility_type", "period": "survey_year",
    "readinessScore": "readiness_score", "staffPresent": "staff_present", "staffRequired": "staff_required",
    "hasElectricity": "has_electricity", "hasWater": "has_water", "stockoutORS": "stockout_ors",
    "stockoutZinc": "stockout_zinc", "stockoutAmox": "stockout_amoxicillin", "stockoutIronFolate": "stockout_iron_folate",
    "old_enum_id": "legacy_enum_id", "new_enum_id": "enumerator_id", "gender": "sex",
}

PROVINCE_OF = {name: province for name, province, *_ in DISTRICTS}
#: Kinds of facilities (fixed values).
FACILITY_KINDS = ("DHQ", "RHC", "BHU")


def districts(spark: SparkSession) -> DataFrame:
    """The 36 districts in matching order."""
    rows = [(i, *row) for i, row in enumerate(DISTRICTS, 1)]
    return spark.createDataFrame(rows, "rank int, district string, province string, centre_lat double, centre_lon double, is_urban boolean")
