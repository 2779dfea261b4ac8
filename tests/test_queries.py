"""Queries against their SQL, on files whose plans draw coordinates near zero."""

import duckdb
import pytest

from palimpsest.plans.queries import ORACLES, QUERIES

#: Images whose plans draw a latitude or longitude within 0.001 of zero, of either sign, and a file of each type besides.
IDS = (549641, 579650, 1293369, 1372114, 1378376, 2565408, 3045456, 3409418, 4678569, *range(8, 16))

rows_of = lambda rows: sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def near_zero(spark, tmp_path_factory):
    """A folder with such ``documents``."""
    path = tmp_path_factory.mktemp("near_zero")
    rows = [(i, "words", ("en", "de")[i % 2], f"src{i % 3}", 100 + i % 50) for i in IDS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def both(spark, path, name):
    """The rows of a query and those of its SQL."""
    got = QUERIES[name](spark, path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    return rows_of(got.collect()), rows_of(con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall())


def test_strict_previews_near_zero_have_the_rows_of_their_sql(spark, near_zero):
    got, want = both(spark, near_zero, "change_preview_poison_strict")
    assert got == want
    assert ("content://docs/1293369", "GPSLatitude", "ADDED", None, "-0.0002", "[ADDED] -0.0002") in got


def test_replaced_images_near_zero_have_the_rows_of_their_sql(spark, near_zero):
    got, want = both(spark, near_zero, "poison_apply_image")
    assert got == want
    assert ("content://docs/1372114", "GPSLongitude", "-0.0005") in got


def test_listed_images_near_zero_have_the_rows_of_their_sql(spark, near_zero):
    got, want = both(spark, near_zero, "poison_apply_image_listed")
    assert got == want
    assert ("content://docs/3045456", "GPSLongitude", "0.0003") in got
