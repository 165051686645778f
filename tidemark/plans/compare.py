"""Runs registered queries beside their check SQL and compares rows, names and values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from tidemark.plans import CHECKS, QUERIES
from tidemark.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


def differences(spark, con, name: str, sf_dir: str) -> list[str]:
    """Empty when the query and its check agree exactly."""
    df = QUERIES[name](spark, sf_dir)
    got = _rows(df.columns, df.collect())
    if name not in CHECKS:
        return [] if got else ["no rows"]
    cursor = con.execute(CHECKS[name])
    names = [c[0] for c in cursor.description]
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    want = _rows(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    found = []
    for field in df.schema.fields:
        if field.dataType.simpleString() == "bigint" and kinds[field.name] in ("HUGEINT", "DOUBLE", "VARCHAR"):
            found.append(f"type of {field.name}: bigint against {kinds[field.name]}")
        if field.dataType.simpleString() == "double" and kinds[field.name] in ("BIGINT", "HUGEINT", "INTEGER"):
            found.append(f"type of {field.name}: double against {kinds[field.name]}")
    if len(got) != len(want):
        found.append(f"{len(got)} rows against {len(want)}")
    bad = [(g, w) for g, w in zip(got, want, strict=False) if g != w]
    if bad:
        found.append(f"{len(bad)} rows differ on {sorted(names)}, first {bad[0][0]} against {bad[0][1]}")
    if not want:
        found.append("check has no rows")
    return found


def main() -> int:
    sf_dir = "/root/testdata/sf0.01"
    chosen = sys.argv[1:] or list(QUERIES)
    spark, con = local_session(8), connect(sf_dir)
    failed = 0
    for name in [q for q in QUERIES if any(q.startswith(c) for c in chosen)]:
        start = time.time()
        try:
            found = differences(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on
            found = [f"{type(error).__name__}: {str(error)[:700]}"]
        failed += bool(found)
        mark = "FAIL" if found else ("ok" if name in CHECKS else "ok (rows)")
        print(f"{mark:10s}{name:34s}{time.time() - start:6.2f}s {'; '.join(found)}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
