"""Rows of a query and of its DuckDB statement in one comparable form."""

import os

import duckdb


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value.isoformat() if hasattr(value, "isoformat") else value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(([plain(r[k]) for k in order] for r in data), key=repr)


def same(spark, query, sql, sf_dir) -> bool:
    out = query(spark, sf_dir)
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    found = con.sql(sql)
    assert sorted(out.columns) == sorted(found.columns)
    return rows(out.columns, [tuple(r) for r in out.collect()]) == rows(found.columns, found.fetchall())
