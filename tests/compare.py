import math

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def sql_rows(con, sql):
    rel = con.sql(sql)
    names = list(rel.columns)
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
