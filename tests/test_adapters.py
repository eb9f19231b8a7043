"""The DataFrame adapter and the independent SQL adapter build identical tables."""

import pytest

from oracle.adapters_sql import VIEWS, with_views
from carelens.sources.adapters import care_tables
from carelens.sources.schemas import TABLE_SCHEMAS
from tests.conftest import SF_SMALL
from tests.harness import compare


@pytest.mark.parametrize("name", list(VIEWS))
def test_adapter_matches_sql(spark, duck_small, name):
    df = care_tables(spark, SF_SMALL).table(name)
    ok, msg = compare(df, duck_small, with_views(f"SELECT * FROM {name}", views=[name]))
    assert ok, msg


@pytest.mark.parametrize("name", list(TABLE_SCHEMAS))
def test_adapter_schema_is_fixed(spark, name):
    df = care_tables(spark, SF_SMALL).table(name)
    assert [(f.name, f.dataType) for f in df.schema.fields] == \
        [(f.name, f.dataType) for f in TABLE_SCHEMAS[name].fields]


def test_injected_faults_present(spark):
    t = care_tables(spark, SF_SMALL)
    assert t.patients.where("zip_code IS NULL").count() > 0
    assert t.encounters.where("patient_id LIKE 'PTX%'").count() > 0
    assert t.patient_surveys.where("Pain_Management IS NULL").count() > 0
