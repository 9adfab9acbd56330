"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import math

import duckdb
import pytest

from tessera.plans import registry
from tests.conftest import SF

#: The smallest tables hold no secret; u3_reasons tests the same operator.
NONE_HERE = {"a5_audit"}
Q, O = registry.queries(), registry.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return repr(v)


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, duck, name):
    df = Q[name](spark, SF)
    rows = df.collect()
    assert rows or name in NONE_HERE, "an empty result compares nothing"
    if name not in O:
        return
    r = duck.sql(O[name])
    assert sorted(r.columns) == sorted(df.columns)
    cols = sorted(df.columns)
    at = [r.columns.index(c) for c in cols]
    assert sorted("|".join(norm(x[c]) for c in cols) for x in rows) == sorted("|".join(norm(x[i]) for i in at) for x in r.fetchall())


def test_entry_works():
    import __spark_entry__ as e

    assert set(O) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_packing_of_turns_that_do_not_fit(spark, tmp_path):
    """Long turns, turns with blank lines, letters and white space at ends, and keys that are null."""
    line = "Some words, and some more of them. "
    texts = [
        *("s", "\\", "sums of s", "　\xa0wide\x1c \x85", "   ", "", None),
        *(("ab " * 900).strip(), "x" * 5000, line * 100, line.replace(".", "") * 100, line.replace(". ", ".\r\n") * 80),
        *("x" * n for n in (1000, 1042, 1043, 600, 601, 2046, 2047, 2048, 2049)),
        *("one\n\ntwo \n  \n three", line * 20 + "\n\n\n" + line * 30 + "\r\n\r\n" + line * 90),
    ]
    rows = [(c, None if k % 5 == 4 else k // 2, None if (k + c) % 4 == 3 else "user", t) for c in range(4) for k, t in enumerate(texts[c:] + texts[:c])]
    rows += [(None, k, "user", t) for k, t in enumerate(texts)] + [(9, 0, "user", "s"), (9, 1, "user", " \\ ")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = Q["t2_packing"](spark, str(tmp_path)).select("conv_id", "chunk_id", "chunk_text", "start_char").collect()
    con = duckdb.connect()
    con.sql(f"create view conversations as from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(f"select conv_id, chunk_id, chunk_text, start_char from ({O['t2_packing']})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert [r.chunk_text for r in got if r.conv_id == 9] == ["s\n\n\\"]
    assert max(len(r.chunk_text) for r in got) == 2048 and {r.conv_id for r in got} == {None, 0, 1, 2, 3, 9}
