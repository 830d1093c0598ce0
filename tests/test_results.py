"""A2 / A3: result-set flattening and lenient getters (edge cases from the reference's getters)."""

from flowlens.sources import results as R


def _flat(spark, bodies):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id long, body string")
    out = R.coerce(R.flatten_result(df, "body", keep=["id"]),
                   {"m": "string", "n": "long", "ok": "bool", "t": "time"})
    return sorted((r["id"], r["row_idx"], r["m"], r["n"], r["ok"], r["t"] and str(r["t"])) for r in out.collect())


def test_columnar_short_rows_and_types(spark):
    got = _flat(spark, ['{"columns":["m","n","ok","t"],"values":[["GET",12.9,1,"2024-01-02 03:04:05"],["x"],'
                        '[7,"9",true,1704067200]]}'])
    assert got == [(0, 0, "GET", 12, True, "2024-01-02 03:04:05"),
                   (0, 1, "x", 0, False, None),                      # short row: absent columns
                   (0, 2, "7", 0, True, "2024-01-01 00:00:00")]       # number as text, string is not a number


def test_object_fallback_and_garbage(spark):
    got = _flat(spark, ['[{"m":"POST","n":-3.7}]', 'not json', '{"other":1}'])
    assert got == [(0, 0, "POST", -3, False, None)]                   # truncation toward zero; others: no rows
