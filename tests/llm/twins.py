from pathlib import Path

import duckdb


def same_as_twin(spark, query, sql, sf):
    """The Spark query and its SQL give the same columns and rows."""
    folder = Path("/root/testdata") / sf
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = query(spark, str(folder))
    result = con.execute(sql)
    columns = sorted(d[0] for d in result.description)
    assert sorted(df.columns) == columns
    names = [d[0] for d in result.description]
    want = sorted((tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in result.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == want
