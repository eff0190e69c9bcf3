import pytest
from conftest import SF, rows_of

from cardloom.plans import catalog_queries, record_queries
from cardloom.session import written

QUERIES = catalog_queries.QUERIES | record_queries.QUERIES
ORACLES = catalog_queries.ORACLES | record_queries.ORACLES


@pytest.fixture(scope="module", autouse=True)
def shared_records():
    """Records are built once for each set of selections, and final records once, as many queries start from them."""
    built, final, held = record_queries.built, record_queries.final, {}

    def built_once(spark, sf, catalog=record_queries.CATALOG):
        key = (sf, *[s.name for s in catalog.selections])
        if key not in held:
            held[key] = written(built(spark, sf, catalog), "records")
        return held[key]

    def final_once(spark, sf):
        if sf not in held:
            held[sf] = final(spark, sf)
        return held[sf]

    record_queries.built, record_queries.final = built_once, final_once
    yield
    record_queries.built, record_queries.final = built, final


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, duck):
    assert rows_of(QUERIES[name](spark, SF).toPandas()) == rows_of(duck.execute(ORACLES[name]).fetchdf())
