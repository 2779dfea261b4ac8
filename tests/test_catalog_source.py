"""The catalogue as a data source."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, Not, StringStartsWith

from palimpsest.sources.catalog_source import CatalogReader, Folder, file_catalog


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    for name, n in (("top.txt", 3), ("a/one.JPG", 10), ("a/deep/two.jpg", 20), ("a/deep/er/.hidden", 5), ("b/three.png", 0), ("b/noext", 7)):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x" * n)
    (root / "empty").mkdir()
    return root


def test_listing(spark, folder):
    rows = {r.name: r for r in file_catalog(spark, str(folder)).collect()}
    assert {n: (r.size_bytes, r.extension) for n, r in rows.items()} == {"top.txt": (3, "txt"), "one.JPG": (10, "jpg"), "two.jpg": (20, "jpg"), ".hidden": (5, ""), "three.png": (0, "png"), "noext": (7, "")}
    assert rows["two.jpg"].path == f"file://{folder}/a/deep/two.jpg" and rows["one.JPG"].modified_ms > 1_600_000_000_000
    assert file_catalog(spark, str(folder / "empty")).collect() == []
    with pytest.raises(Exception, match="(?i)no such|not found|does not exist"):
        file_catalog(spark, str(folder / "missing")).collect()
    with pytest.raises(Exception, match="no columns"):
        spark.read.format("file_catalog").schema("colour string").load(str(folder)).collect()


@pytest.mark.parametrize(
    "condition",
    ["size_bytes > 5", "size_bytes <= 7 and extension = ''", "extension in ('jpg', 'png')", "path like '%/a/deep/%'", "name like 'two%'", "name like '%.png'", "size_bytes <> 10", "extension = 'jpg' or size_bytes = 7", "name is null", "size_bytes is not null"],
)
def test_filters_change_no_rows(spark, folder, condition):
    found = file_catalog(spark, str(folder))
    want = sorted(r.path for r in spark.createDataFrame(found.collect(), found.schema).where(condition).collect())
    assert sorted(r.path for r in found.where(condition).collect()) == want


def test_pushed_filters_are_gone_from_the_plan(spark, folder):
    found = file_catalog(spark, str(folder)).where((F.col("size_bytes") > 5) & (F.col("extension") == "jpg"))
    assert found.count() == 2
    assert "Filter (" not in found._jdf.queryExecution().executedPlan().toString().replace("PushedFilters", "")


def reader(folder, *columns):
    return CatalogReader(str(folder), list(columns))


def test_a_listing_reads_no_byte(folder, monkeypatch):
    read = []
    monkeypatch.setattr(CatalogReader, "_content", lambda self, fs, path: read.append(path) or b"")
    plain = reader(folder, "path", "size_bytes")
    assert sum(b.num_rows for p in plain.partitions() for b in plain.read(p)) == 6 and not read
    some = reader(folder, "path", "content")
    left = list(some.pushFilters([EqualTo(("extension",), "jpg"), GreaterThan(("size_bytes",), 10), IsNotNull(("path",)), Not(EqualTo(("name",), "x"))]))
    assert left == [Not(EqualTo(("name",), "x"))]
    assert sum(b.num_rows for p in some.partitions() for b in some.read(p)) == 1 and len(read) == 1


def test_folders_that_no_path_begins_with_are_not_listed(folder):
    one = reader(folder, "path")
    assert list(one.pushFilters([StringStartsWith(("path",), f"file://{folder}/a/de"), In(("name",), ("two.jpg", "z"))])) == []
    assert one.partitions() == [Folder(f"file://{folder}", False), Folder(f"file://{folder}/a", True)]
    assert [r["path"] for p in one.partitions() for b in one.read(p) for r in b.to_pylist()] == [f"file://{folder}/a/deep/two.jpg"]


def test_content(spark, folder):
    got = {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in file_catalog(spark, str(folder), "path", "content").where(F.col("path").contains("/a/")).collect()}
    assert got == {"one.JPG": b"x" * 10, "two.jpg": b"x" * 20, ".hidden": b"x" * 5}
