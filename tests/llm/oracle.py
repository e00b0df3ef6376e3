"""Rows of a frame against DuckDB's over the same rows."""

import duckdb


def rows(df, digits=6):
    clean = lambda v: round(v, digits) if isinstance(v, float) else v
    names = sorted(df.columns)
    return sorted((tuple(clean(r[c]) for c in names) for r in df.collect()), key=repr)


def sql_rows(sql, digits=6, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    clean = lambda v: round(v, digits) if isinstance(v, float) else v
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted((tuple(clean(r[i]) for i in at) for r in got.fetchall()), key=repr)
