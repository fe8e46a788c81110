"""Registered queries against their SQL on rows that only large tables hold."""

import json
import random

import duckdb

import __spark_entry__
from specimen.operators import jsondoc, profile


def differences(spark, folder, name, table, rows):
    """Rows of the query's result that its SQL lacks, and the other way round, over one table made by SQL."""
    db = duckdb.connect()
    db.execute(f"COPY ({rows}) TO '{folder}/{table}.parquet'")
    got = [tuple(r) for r in __spark_entry__.queries()[name](spark, str(folder)).collect()]
    db.execute(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet'")
    want = db.execute(__spark_entry__.oracle_sql()[name]).fetchall()
    assert want
    return sorted(set(got) - set(want)), sorted(set(want) - set(got)), len(got) - len(want)


ORDERS = "SELECT {key} AS o_orderkey, k % 7 AS o_custkey, ['O', 'F', 'P'][k % 3 + 1] AS o_orderstatus, CAST({price} AS DOUBLE) / 4 AS o_totalprice, TIMESTAMP '1995-01-01' + to_days(CAST(k % 50 AS INT)) AS o_orderdate, ['1-URGENT', '5-LOW'][k % 2 + 1] AS o_orderpriority FROM range(200) t(k)"


def test_serials_of_large_keys(spark, tmp_path):
    rows = ORDERS.format(key="[k, 2957000 + k * 20, 8999800 + k][k % 3 + 1]", price="k")
    assert differences(spark, tmp_path, "time_excel", "orders", rows) == ([], [], 0)


def test_identifiers_that_repeat_a_lot(spark, tmp_path):
    rows = ORDERS.format(key="k", price="k % 20")
    assert differences(spark, tmp_path, "csv_findings", "orders", rows) == ([], [], 0)
    ids = lambda **kw: {r["id"] for r in profile.profile_table(spark.read.parquet(f"{tmp_path}/orders.parquet"), **kw)["findings"].collect()}
    assert ids(keys=["o_totalprice"]) - ids() == {"uniqueness-3-dupkey"}


def test_json_rules_scan_each_text_once(spark, tmp_path):
    assert differences(spark, tmp_path, "json_rules", "events", "SELECT 3000000000 + k AS event_id FROM range(100) t(k)") == ([], [], 0)
    plan = __spark_entry__.queries()["json_rules"](spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Scan parquet") == 1


def written(r, depth=0):
    """A random document as text: keys repeat, differ by case, are padded or hold what cannot be seen."""
    kind = r.choice("oaaosnbvl" if depth < 4 else "snbvl")
    if kind == "o":
        return "{" + ",".join(f"{json.dumps(r.choice(['a', 'A', 'b', ' b', '', 'k​', 'é', 'É', '/~', 'ﬁ']), ensure_ascii=r.random() < 0.5)}:{written(r, depth + 1)}" for _ in range(r.randrange(4))) + "}"
    if kind == "a":
        one = written(r, depth + 1)
        return "[" + ",".join(one if r.random() < 0.3 else written(r, depth + 1) for _ in range(r.choice([0, 0, 2, 4, 14]))) + "]"
    return {"s": r.choice(['""', '"x"', '"\\ud800"', '" y"', '"\\ue000"', '"\\u0000"', '"\U000e0041"']), "n": r.choice(["1", "-0", "9007199254740991", "-9007199254740992", "12345678901234567890", "1e400", "-1E308", "1234567890123456.5"]), "b": "true", "v": "null", "l": "null"}[kind]


def test_findings_in_one_pass_are_those_on_the_node_table(spark):
    r = random.Random(5)
    texts = [written(r) for _ in range(600)] + [None, "", "{", "[" * 17 + "]" * 17, "[" * 40 + "]" * 40, json.dumps([0] * 1000), json.dumps({str(k): k for k in range(100)}), json.dumps("x" * 8192), '{"a":[{"b":1},{"b":2}],"a":[{"b":"x"},{}]}', "[" + ",".join(['{"x":null,"y":"","z":{}}'] * 13 + ['{"x":1,"y":[]}', '{"x":true}']) + "]"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    show = lambda f: sorted(f.collect(), key=lambda x: (int(x["subject"]), x["id"]))
    n = jsondoc.nodes(df, "id", "t").cache()
    want, got = show(jsondoc.findings(n)), show(jsondoc.document_findings(df, "id", "t"))
    n.unpersist()
    assert got == want and len({x["id"].split("-/")[0] for x in got}) >= 18


def test_json_rules_has_work_for_every_task(spark, tmp_path):
    duckdb.execute(f"COPY (SELECT k AS event_id FROM range(60000) t(k)) TO '{tmp_path}/events.parquet' (row_group_size 100000)")
    plan = __spark_entry__.queries()["json_rules"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    dealt = plan[plan.index("MapInArrow") :].splitlines()
    at = next(k for k, line in enumerate(dealt) if "REPARTITION_BY_COL" in line)  # ids alone, before their texts are made
    assert "hashpartitioning(" in dealt[at] and "Project" in dealt[at - 1] and "Scan parquet [event_id#" in "".join(dealt[at + 1 :]).replace("FileScan", "Scan")
