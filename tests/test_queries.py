"""Registered queries against their SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
# the driver runs all of them; here one of each kind
NAMES = ["overlap_pairs", "overlap_polygons_with_holes", "overlap_clusters", "conflict_zones", "probe_points",
         "normalized_cases", "enriched_cases", "municipality_summary", "eviction_reports", "kml_document",
         "geojson_lines", "notices_in_state", "numbered_parcels", "version_changes", "streamed_cases"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    ok, note = check.compare(spark, check.connect(SF), SF, name)
    assert ok, note


def test_entry(spark):
    assert "traditional_name" in entry.entry(spark).columns


def test_summary_has_five_seats_with_all_municipalities(spark):
    """Whole lists: a seat covers a fifth of all municipalities, whatever their number."""
    rows = entry.queries()["municipality_summary"](spark, "/root/testdata/sf0.01").select(
        "tjpe_comarca_nome", "tjpe_total_municipios_comarca", "tjpe_comarca_abrangencia").collect()
    assert len({r[0] for r in rows}) == 5 and {r[1] for r in rows} == {len(rows) // 5}
    assert all(len(r[2].split("; ")) == r[1] for r in rows)


def test_summary_keeps_lists_out_of_sorts_and_once_in_a_file(spark, tmp_path):
    """A fifth of all names in every row: the lists are sorted nowhere, rows are dealt to all tasks, and a file has each list
    once, also where they are larger than the dictionary that is set."""
    pq = pytest.importorskip("pyarrow.parquet")
    from landspark.session import shares
    size = "parquet.dictionary.page.size"
    spark.conf.set(size, "300")  # the lists have 340 bytes each
    try:
        out = entry.queries()["municipality_summary"](spark, "/root/testdata/sf0.01")
        assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.rdd.getNumPartitions() == shares(spark)
        out.coalesce(1).write.parquet(str(tmp_path / "out"))
        assert int(spark.conf.get(size)) > 1500
    finally:
        spark.conf.unset(size)
    meta = pq.ParquetFile(next((tmp_path / "out").glob("*.parquet"))).metadata.row_group(0)
    lists = next(c for c in map(meta.column, range(meta.num_columns)) if c.path_in_schema == "tjpe_comarca_abrangencia")
    assert meta.num_rows == 100 and lists.total_uncompressed_size < 5000
