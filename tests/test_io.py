"""CSV scan with the fixed schema: types and dates parsed, malformed rows kept
as NULLs with their raw text in the corrupt-record column."""

import datetime as dt

from carelens.sources.io import CORRUPT, read_csv_table
from carelens.sources.schemas import ENCOUNTERS


def test_read_encounters_csv(spark, tmp_path):
    header = ",".join(f.name for f in ENCOUNTERS.fields)
    good = "ENC0000001,PT000001,2024-03-05,Inpatient,Cardiology,3.5,Home,1,0,I10,DR0001,1234.56"
    bad = "ENC0000002,PT000002,not-a-date,ED,Oncology,x,Home,0,1,E11,DR0002,10.00"
    path = tmp_path / "encounters.csv"
    path.write_text("\n".join([header, good, bad]) + "\n")
    df = read_csv_table(spark, str(path), "encounters", keep_corrupt=True)
    assert [f.dataType for f in df.schema.fields[:-1]] == [f.dataType for f in ENCOUNTERS.fields]
    rows = {r["encounter_id"]: r for r in df.collect()}
    assert rows["ENC0000001"]["encounter_date"] == dt.date(2024, 3, 5)
    assert rows["ENC0000001"]["length_of_stay"] == 3.5 and rows["ENC0000001"][CORRUPT] is None
    assert rows["ENC0000002"]["encounter_date"] is None and rows["ENC0000002"][CORRUPT] == bad
