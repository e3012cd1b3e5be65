"""Queries against their SQL on small tables of cases that the given ones are too small for."""

import duckdb

from siftgrid.plans import registry


def both(spark, path, name, **tables):
    """Sorted rows of the query, and of its SQL."""
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{table}.parquet")
        con.sql(f"create view {table} as select * from '{path}/{table}.parquet/*.parquet'")
    df = registry.queries()[name](spark, str(path))
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    return sorted(map(tuple, df.select(*want.columns).collect())), sorted(want.fetchall())


def test_url_scope_of_large_page_ids(spark, tmp_path):
    found, want = both(spark, tmp_path, "url_scope", pages=("page_id long, url string, html string", [(i, "https://a.org/", "") for i in (6, 16, 256, 306, 996, 1006, 1011, 1036, 12816, 1234566)]))
    assert found == want and {r[3] for r in found} == {True, False}


ODD = [
    "von 82.197.113.214 geieein. Stää zu", "ä555-123-4567 und 555-123-4567ä", "é123-45-6789 123-45-6789é", "ß4111 1111 1111 1111ß", "12 Main Streetä 12 Main St", "5 Old\x0bRoad Lane 5 Old\tRoad Lane", "555-123-4567+15551234567 end", "555\x0b123\x0b4567",
    "9 King Lane and 9 Baſ ſt", "a@b.cö (555) 123-4567(555) 123-4567", "x123-45-6789 _123-45-6789_", "",
]


def test_pii_scrub_beside_other_letters(spark, tmp_path):
    docs = ("doc_id long, text string, lang string", [(i, t, "de") for i, t in enumerate([*ODD, None])])
    talks = ("conv_id long, turn int, text string", [(i, 0, t) for i, t in enumerate(ODD)])
    found, want = both(spark, tmp_path, "pii_scrub", documents=docs, conversations=talks)
    assert found == want
    found, want = both(spark, tmp_path / "n", "pii_counts", documents=docs)
    assert found == want


def test_sensitive_findings_at_line_ends_and_other_letters(spark, tmp_path):
    key = "Qz7" + "x1Y2w3V4" * 3
    texts = [f"token={key}\ntoken={key}\n token={key}", f"a\n\ntoken: {key}", "ä93.184.216.34 und 93.184.216.35ä", "é5500005555555559 5500005555555559ß", f"toKen={key}s", f"ſtoken={key}", "", None]
    rows = [(i, t, "src1") for i, t in enumerate(texts)] + [(50, texts[0], "src2"), (50, texts[0], "src2"), (None, texts[2], "src3")]
    found, want = both(spark, tmp_path, "sensitive_findings_by_source", documents=("doc_id long, text string, source string", rows))
    assert found == want and sum(r[1] for r in found) > 8
