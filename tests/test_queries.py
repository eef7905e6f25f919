"""Registered queries against their SQL at the smallest scale."""

import os

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from webloom.functions import nodes

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    frame = entry.queries()[name](spark, SF)
    names = sorted(frame.columns)
    want = con.sql(f"select {', '.join(f'\"{n}\"' for n in names)} from ({entry.oracle_sql()[name]})").fetchall()
    tidy = lambda rows: sorted((tuple(round(float(v), 6) if isinstance(v, (int, float)) else v for v in r) for r in rows), key=repr)
    assert tidy(frame.select(*names).collect()) == tidy(want)


def test_pagination_of_given_pages(spark, tmp_path):
    links = ["", "<a>next</a>", '<p class="next">no</p><button class="b go-next" >x</button>', "<a href='/x'>&raquo;</a>", '<a href="/y">\n>\n</a><a id="n"> Next Page </a>', '<button> NEXT </button>', '<a class="next">']
    urls = ["https://x.example/", "https://x.example/a?page=2", "https://x.example/p/3", None]
    rows = [(i, urls[i % 4], None if i == 27 else f"<html><body>{link}") for i, link in enumerate(links * 4)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    frame = entry.queries()["pagination_type"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(map(tuple, frame.collect()), key=repr)
    assert got == sorted(con.sql(f"select {', '.join(frame.columns)} from ({entry.oracle_sql()['pagination_type']})").fetchall(), key=repr)
    own = {r[0]: r[2:] for r in got if r[1]}
    assert len(own) == 28 and own[1] == ("next_button", "a:contains('Next')", None) and own[2][1] == ".b.go-next" and own[4][1] == "#n" and own[6][1] == ".next"
    assert own[3] == ("none", None, None) and own[21] == ("url_param", None, "guessed_from_url") and own[10][0] == "url_param"


@pytest.mark.parametrize("name", ["listing_collect", "dom_depth", "tree_export", "stable_selectors", "listing_sections", "best_units", "subtree_words", "listing_preview", "listing_extract"])
def test_listings_are_held_in_small_parts(spark, monkeypatch, name):
    """All pages come in one batch, which no task may hold as trees at once."""
    sf, parse = SF.replace("0.001", "0.01"), nodes._nodes
    if not os.path.isdir(sf):
        pytest.skip("no test data")

    def strict(pages: pa.Array) -> pa.Array:
        if len(pages) > 1 and sum(len(p or "") for p in pages.to_pylist()) > 1 << 16:
            raise MemoryError(f"{len(pages)} pages at once")
        return parse(pages)

    monkeypatch.setattr(nodes, "HELD", 1 << 16, raising=False)
    monkeypatch.setattr(nodes, "_nodes", strict)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        con = duckdb.connect()
        con.sql(f"create view part as select * from '{sf}/part.parquet'")
        frame = entry.queries()[name](spark, sf)
        names = sorted(frame.columns)
        want = con.sql(f"select {', '.join(f'\"{n}\"' for n in names)} from ({entry.oracle_sql()[name]})").fetchall()
        tidy = lambda rows: sorted((tuple(round(float(v), 6) if isinstance(v, (int, float)) else v for v in r) for r in rows), key=repr)
        assert tidy(frame.select(*names).collect()) == tidy(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
