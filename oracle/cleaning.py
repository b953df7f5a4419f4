"""Expected results of the cleaning jobs."""

from .spelling import with_shapes

PERSON = "patient_id, first_name, last_name, date_of_birth"
_CLOCK = "([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?)?"
_SPELLED = "regexp_extract_all(admission_date, '[0-9]+')"
DAY = f"""TRY_CAST(CASE
    WHEN regexp_full_match(admission_date, ' *[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}{_CLOCK} *')
        THEN concat({_SPELLED}[1], '-', {_SPELLED}[2], '-', {_SPELLED}[3])
    WHEN regexp_full_match(admission_date, ' *[0-9]{{8}} *')
        THEN concat(substr(trim(admission_date), 1, 4), '-', substr(trim(admission_date), 5, 2), '-', substr(trim(admission_date), 7))
    END AS DATE)"""
GENDER = (
    "CASE WHEN upper(gender) IN ('M', 'MALE') THEN 'Male' "
    "WHEN upper(gender) IN ('F', 'FEMALE') THEN 'Female' ELSE 'Unknown' END"
)
STREET = "split_part(patient_address, ',', 1)"
CITY = "CASE WHEN contains(patient_address, ',') THEN split_part(patient_address, ',', 2) ELSE patient_address END"
STATE = "split_part(patient_address, ',', -1)"
PHONE = "coalesce(nullif(phone_number, ''), 'Not Provided')"
NEWEST = f"row_number() OVER (PARTITION BY {PERSON} ORDER BY {DAY} DESC NULLS LAST, record_id)"

_BODIES = {
    "patient_preview": "SELECT * FROM patient_records",
    "patient_admission_date": f"SELECT record_id, admission_date, {DAY} AS standardized_date FROM patient_records",
    "patient_rejected_dates": f"""
        SELECT count(*) AS rejected FROM patient_records WHERE admission_date IS NOT NULL AND {DAY} IS NULL""",
    "patient_gender_counts": "SELECT gender, count(*) AS records FROM patient_records GROUP BY ALL",
    "patient_gender_std": f"SELECT * REPLACE ({GENDER} AS gender) FROM patient_records",
    "patient_address_parts": f"""
        SELECT patient_address, {STREET} AS street, {CITY} AS city, {STATE} AS state FROM patient_records""",
    "patient_address_split": f"""
        SELECT *, trim({STREET}) AS street, trim({CITY}) AS city, trim({STATE}) AS state FROM patient_records""",
    "patient_missing_phone": """
        SELECT patient_id, phone_number FROM patient_records WHERE coalesce(phone_number, '') = ''""",
    "patient_phone_fill": f"SELECT * REPLACE ({PHONE} AS phone_number) FROM patient_records",
    "patient_dedupe": f"""
        WITH placed AS (
            SELECT {PERSON}, row_number() OVER (PARTITION BY {PERSON} ORDER BY admission_date DESC) AS place
            FROM patient_records
        )
        SELECT r.* FROM patient_records r
        WHERE NOT EXISTS (
            SELECT 1 FROM placed p
            WHERE p.place > 1 AND p.patient_id = r.patient_id AND p.first_name = r.first_name
              AND p.last_name = r.last_name AND p.date_of_birth = r.date_of_birth
        )""",
    "patient_dedupe_fixed": f"SELECT * FROM patient_records QUALIFY {NEWEST} = 1",
    "patient_clean": f"""
        WITH newest AS (SELECT * FROM patient_records QUALIFY {NEWEST} = 1)
        SELECT
            record_id, {PERSON}, {DAY} AS admission_date, {GENDER} AS gender, patient_address,
            {PHONE} AS phone_number, trim({STREET}) AS street, trim({CITY}) AS city, trim({STATE}) AS state
        FROM newest""",
}

SQL = {key: with_shapes(body) for key, body in _BODIES.items()}
SQL["patients_cleaned_in_place"] = SQL["patient_clean"]
