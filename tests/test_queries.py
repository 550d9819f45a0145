"""Every query that SQL can express, against DuckDB; the others run and return rows."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from tests_support import DATA, same

from tessellex.queries import QUERIES, SQL


SF = str(DATA / "sf0.001")


@pytest.fixture(scope="module")
def results(spark, request):
    """The selected queries' results to come: small jobs mostly wait, so several queries run at once."""
    names = [i.callspec.params["name"] for i in request.session.items if i.module is request.module and hasattr(i, "callspec")]
    pool = ThreadPoolExecutor(5)
    yield {n: pool.submit(lambda n=n: QUERIES[n](spark, SF).toPandas()) for n in names}
    pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(results, duck, name):
    got = results[name].result()
    if name in SQL:
        same(got, duck(SF).execute(SQL[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
