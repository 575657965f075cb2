"""Shared helpers of the tests."""

import os

import duckdb

DATA = "/root/testdata/sf0.001"


def duck(folder: str = DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return con


def canonical(rows, names):
    """Rows as sorted tuples of text, columns by name."""
    order = sorted(range(len(names)), key=lambda i: names[i])

    def text(v):
        if v is None or v != v:
            return "null"
        return repr(round(float(v), 6) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(text(r[i]) for i in order) for r in rows), [names[i] for i in order]


def same(df, db, sql):
    got, names = canonical([tuple(r) for r in df.collect()], df.columns)
    cur = db.execute(sql)
    want, wanted = canonical(cur.fetchall(), [c[0] for c in cur.description])
    assert names == wanted
    assert len(got) == len(want)
    assert got == want
