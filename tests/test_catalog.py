import pytest
from pyspark.sql import functions as F

from wikiloom.operators import catalog
from wikiloom.sources import catalog_files

COLUMNS = "seq long, referenceid string, endpoint string, resolverid string, displaycolor string"


def table(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], COLUMNS)


def ids(df):
    return [(r.seq, r.referenceid) for r in df.orderBy("seq").collect()]


@pytest.fixture
def repeated(spark):
    return table(
        spark,
        [
            ("a", "u0", "generic", "1"),
            ("!disabled", "u1", "generic", "1"),
            ("a", "u2", "generic", "1"),
            ("A", "u3", "generic", "1"),
            ("a", "u4", "generic", "1"),
            ("a", "u5", "generic", "1"),
            ("!disabled", "u6", "generic", "1"),
            (None, "u7", "generic", None),
        ],
    )


def test_first_row_per_id_wins(repeated):
    assert ids(catalog.load(repeated)) == [(0, "a"), (3, "A"), (7, "")]


def test_reference_mode_drops_the_second_row_only(repeated):
    assert ids(catalog.load(repeated, "reference")) == [
        (0, "a"), (3, "A"), (4, "a"), (5, "a"), (7, ""),
    ]


def test_report_counts_what_is_loaded(repeated):
    for mode in ("default", "reference"):
        report = catalog.load_report(repeated, mode).first()
        assert report.loaded == catalog.load(repeated, mode).count()
        assert report.repeated_ids == 1


def test_files_rank_before_rows(spark):
    first = table(spark, [("x", "u0", "g", "1"), ("a", "u1", "g", "1")])
    second = table(spark, [("a", "u2", "g", "1"), ("b", "u3", "g", "1")])
    got = {r.referenceid: r.endpoint for r in catalog.load_combined([second, first]).collect()}
    assert got == {"a": "u2", "b": "u3", "x": "u0"}


def new_rows(spark, rows):
    return spark.createDataFrame(
        rows, "seq long, referenceid string, endpoint string, resolverid string, color int"
    )


def test_extend_appends_what_is_missing(spark, repeated):
    new = new_rows(
        spark,
        [
            (0, "n", "u1", "generic", None),  # known, though disabled
            (1, "n", "u9", "generic", 0x00CC99),
            (2, "m", "u9", "wikia", None),
        ],
    )
    rows = catalog.extend(repeated, new).orderBy(*catalog.EXTENDED_ORDER).collect()
    assert [r.endpoint for r in rows] == [f"u{i}" for i in range(8)] + ["u9", "u9"]
    assert [r.displaycolor for r in rows[-2:]] == ["#00cc99", "!random"]
    report = catalog.export_report(repeated, new).first()
    assert (report.previous_rows, report.new_rows) == (8, 2)
    distinct = catalog.extend(repeated, new, distinct=True).filter("part = 1").collect()
    assert [(r.referenceid, r.endpoint) for r in distinct] == [("n", "u9")]


def test_exported_colour_can_be_loaded(spark, repeated):
    extended = catalog.extend(repeated, new_rows(spark, [(0, "n", "u9", "generic", 0xAB)]))
    again = catalog.load(extended.filter("part = 1"))
    assert again.first().color == 0xAB


CSV = (
    'referenceid,endpoint,resolverid,displaycolor\r\n'
    'a,"https://x.org/""quoted"",w",generic,!random\r\n'
    'short,only\r\n'
    'b,"two\nlines",,#00cc99\r\n'
)


def test_csv_dialect_order_and_quarantine(spark, tmp_path):
    (tmp_path / "1.csv").write_bytes(CSV.encode())
    (tmp_path / "2.csv").write_text("referenceid,endpoint,resolverid,displaycolor\na,u,generic,1\n")
    rows = catalog_files.read_csv(spark, str(tmp_path))
    good = catalog_files.well_formed_rows(rows)
    assert [tuple(r)[1:] for r in good.orderBy("seq").collect()] == [
        ("a", 'https://x.org/"quoted",w', "generic", "!random"),
        ("b", "two\nlines", None, "#00cc99"),
        ("a", "u", "generic", "1"),
    ]
    assert [r._corrupt_record.strip() for r in catalog_files.quarantined_rows(rows).collect()] == ["short,only"]
    loaded = {r.referenceid: (r.resolverid, r.color) for r in catalog.load(good).collect()}
    assert loaded["b"] == ("", 0x00CC99) and set(loaded) == {"a", "b"}


def test_csv_round_trip_keeps_order(spark, tmp_path, repeated):
    path = str(tmp_path / "out")
    catalog_files.write_csv(repeated, path, ["seq"])
    again = catalog_files.well_formed_rows(catalog_files.read_csv(spark, path))
    assert [r.endpoint for r in again.orderBy("seq").collect()] == [f"u{i}" for i in range(8)]


def test_snapshots_switch_when_complete(spark, tmp_path, repeated):
    root = str(tmp_path / "catalog")
    with pytest.raises(FileNotFoundError):
        catalog_files.read_snapshot(spark, root)
    catalog_files.write_snapshot(repeated, root, ["seq"])
    old = catalog_files.read_snapshot(spark, root)
    new = new_rows(spark, [(0, "n", "u9", "generic", None)])
    catalog_files.write_snapshot(catalog.extend(old, new), root, catalog.EXTENDED_ORDER)
    (tmp_path / "catalog" / "snapshot-000000000007").mkdir()  # writing not finished
    latest = catalog_files.read_snapshot(spark, root)
    assert [r.endpoint for r in latest.orderBy("seq").collect()] == [f"u{i}" for i in range(8)] + ["u9"]
    # Adding the same again adds nothing.
    assert catalog.export_report(latest, new).first().new_rows == 0
    assert old.count() == 8


def test_dump_file_by_its_own_header(spark, tmp_path):
    (tmp_path / "d.csv").write_text('lang,statsurl,http\nEnglish,"http://a.org/x",200\n,http://b.org,404\n')
    dump = catalog_files.read_dump(spark, str(tmp_path / "d.csv"))
    assert dump.columns == ["lang", "statsurl", "http"]
    from wikiloom.operators import harvest

    links = harvest.statsurl_links(harvest.in_language(dump, "ENGLISH"))
    assert [r.url for r in links.orderBy("url").collect()] == ["http://a.org", "http://b.org"]
    assert harvest.in_language(dump.drop("lang"), "French").count() == 2
