"""Run registered queries next to their SQL and compare rows."""
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def oracle(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    if isinstance(v, bool):
        return str(v)
    return str(v)


def differences(spark_df, rel):
    """Empty text when columns, types of class and the bag of rows agree."""
    scols, dcols = sorted(spark_df.columns), sorted(rel.columns)
    if scols != dcols:
        return f"columns {scols} vs {dcols}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    st = dict(spark_df.dtypes)
    dt = dict(zip(rel.columns, [str(t) for t in rel.types]))
    bad = [f"{c}: {st[c]} vs {dt[c]}" for c in scols if kinds.get(st[c], st[c]) != dt[c]]
    left = sorted(tuple(_norm(r[c]) for c in scols) for r in spark_df.collect())
    right = sorted(tuple(_norm(r[rel.columns.index(c)]) for c in scols) for r in rel.fetchall())
    out = ("types " + "; ".join(bad)) if bad else ""
    if not left and not right:
        out += " EMPTY"
    if left != right:
        extra = [r for r in left if r not in set(right)][:3]
        missing = [r for r in right if r not in set(left)][:3]
        out += f" rows {len(left)} vs {len(right)}: spark {extra} sql {missing}"
    return out.strip()


def main(folder, names):
    import __spark_entry__ as entry
    from hourwise.session import local_session
    spark = local_session("8", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if names and not any(name == n or name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            df = queries[name](spark, folder)
            if name in sql:
                msg = differences(df, con.sql(sql[name]))
            else:
                rows = df.collect()
                msg = f"(rows only) {len(rows)} {rows[:2] if names else ''}"
        except Exception as e:  # noqa: BLE001
            msg = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        bad += bool(msg) and not msg.startswith("(rows")
        print(f"{name:40s} {time.time() - t:6.2f}s {msg or 'ok'}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    main(sys.argv[1], sys.argv[2:])
