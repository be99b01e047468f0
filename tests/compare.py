"""Comparison of Spark results with SQL results."""

from __future__ import annotations


def cells(row) -> tuple:
    """A row in one spelling for both engines."""
    out = []
    for x in row:
        if x is None or isinstance(x, (str, bool)):
            out.append(x)
        elif type(x).__name__ in ("float", "Decimal"):
            out.append(round(float(x), 6))
        else:
            out.append(str(x))
    return tuple(out)


def same_rows(spark_df, connection, sql: str) -> None:
    """Fail unless both results have the same columns and the same bag of rows."""
    columns = sorted(spark_df.columns)
    found = sorted((cells(r) for r in spark_df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    wanted = sorted((cells([r[i] for i in at]) for r in result.fetchall()), key=repr)
    assert found == wanted
