import datetime as dt

import pytest

from saleslens.plans import cleaning

from conftest import values

PATIENTS = (
    "record_id long, patient_id long, first_name string, last_name string, date_of_birth date, "
    "admission_date string, gender string, patient_address string, phone_number string"
)
BORN = dt.date(1980, 1, 1)
ROWS = [
    (1, 10, "Ann", "Lee", BORN, "2024-01-05 08:30:00", "F", "1 Main St, Springfield, IL", "555"),
    (2, 10, "Ann", "Lee", BORN, "2024-03-01", "Female", "1 Main St,  Springfield ,IL", None),
    (3, 10, "Ann", "Lee", BORN, "n/a", "FEMALE", "PO Box 7", ""),
    (4, 11, "Bob", None, BORN, "2024-01-01", "M", "a, b, c, d", "556"),
    (5, 11, "Bob", None, BORN, "2024-01-02", "x", "a, b", "557"),
    (6, 12, "Cy", "Ray", BORN, "2024-05-05", None, None, "558"),
    (7, 13, "Di", "Fox", BORN, "2024-05-05", "male", "", "559"),
    (8, 13, "Di", "Fox", BORN, "2024-05-05", "male", "", "560"),
]


@pytest.fixture
def tables(frame):
    return {"patient_records": frame(ROWS, PATIENTS)}


def test_admission_dates(tables):
    got = dict(values(cleaning.patient_admission_date(tables), "record_id", "standardized_date"))
    assert got[1] == dt.date(2024, 1, 5) and got[2] == dt.date(2024, 3, 1) and got[3] is None
    assert cleaning.rejected_admissions(tables).first().rejected == 1


@pytest.mark.parametrize("text, day", [
    ("2024-01-31", "2024-01-31"), ("2024/01/31", "2024-01-31"), ("20240131", "2024-01-31"), (" 2024-1-5 ", "2024-01-05"),
    ("2024-01-31 08:30:00", "2024-01-31"), ("2024-01-31T08:30", "2024-01-31"), ("2024", None), ("2024-05", None),
    ("+2024", None), ("2024-01-31 garbage", None), ("2024-02-30", None), ("20241301", None), ("", None), ("n/a", None),
])
def test_only_full_dates_count(frame, text, day):
    tables = {"patient_records": frame([(1, 1, "a", "b", BORN, text, None, None, None)], PATIENTS)}
    row = cleaning.patient_admission_date(tables).first()
    assert row.standardized_date == (dt.date.fromisoformat(day) if day else None)
    assert cleaning.rejected_admissions(tables).first().rejected == (day is None)
    assert cleaning.patient_clean(tables).first().admission_date == row.standardized_date


def test_gender(tables):
    got = dict(values(cleaning.patient_gender_std(tables), "record_id", "gender"))
    assert [got[i] for i in range(1, 9)] == ["Female"] * 3 + ["Male", "Unknown", "Unknown", "Male", "Male"]
    assert (None, 1) in values(cleaning.patient_gender_counts(tables))


def test_address(tables):
    raw = {r.patient_address: r for r in cleaning.patient_address_parts(tables).collect()}
    assert raw["1 Main St,  Springfield ,IL"].city == "  Springfield "
    got = {r.record_id: (r.street, r.city, r.state) for r in cleaning.patient_address_split(tables).collect()}
    assert got[2] == ("1 Main St", "Springfield", "IL")
    assert got[3] == ("PO Box 7",) * 3
    assert got[4] == ("a", "b", "d")
    assert got[6] == (None, None, None)


def test_phone(tables):
    assert values(cleaning.patient_missing_phone(tables)) == [(10, ""), (10, None)]
    got = dict(values(cleaning.patient_phone_fill(tables), "record_id", "phone_number"))
    assert got[2] == got[3] == "Not Provided" and got[1] == "555"


def test_dedupe_literal_removes_all_copies_but_keeps_null_keys(tables):
    assert values(cleaning.patient_dedupe(tables), "record_id") == [(4,), (5,), (6,)]


def test_dedupe_fixed_keeps_newest_then_lowest_record(tables):
    assert values(cleaning.patient_dedupe_fixed(tables), "record_id") == [(2,), (5,), (6,), (7,)]


def test_clean_does_all_steps(tables):
    got = {r.record_id: r for r in cleaning.patient_clean(tables).collect()}
    assert set(got) == {2, 5, 6, 7}
    two = got[2]
    assert (two.admission_date, two.gender, two.city, two.phone_number) == (
        dt.date(2024, 3, 1),
        "Female",
        "Springfield",
        "Not Provided",
    )


def test_preview_is_the_table(tables):
    assert values(cleaning.patient_preview(tables)) == values(tables["patient_records"])


def test_column_steps_work_on_a_stream(spark, tables, tmp_path):
    tables["patient_records"].write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(tables["patient_records"].schema).json(str(tmp_path / "in"))
    for step in (
        cleaning.standardize_admission,
        cleaning.standardize_gender,
        cleaning.split_address,
        cleaning.fill_phone,
    ):
        stream = step(stream)
    query = (
        stream.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = tables["patient_records"]
    batch = cleaning.fill_phone(cleaning.split_address(cleaning.standardize_gender(cleaning.standardize_admission(batch))))
    assert values(got, *batch.columns) == values(batch)
