import difflib

import pytest
from pyspark.sql import functions as F

from tessera.operators import compare as cmp
from tessera.operators import profile, reconcile, relationships, verify
from tessera.plans.errors import Unsupported
from tessera.plans.model import SemanticModel
from tessera.queries import inventories
from tessera.sources import calendar, readers
from tessera.streaming import events as stream


def test_parameter_lifting():
    sql = "SELECT a, b FROM t WHERE a = <[Parameters].[P]> AND c > 1 ORDER BY a"
    assert readers.lift_parameters(sql, ["a", "b"]) == ("SELECT a, b FROM t WHERE c > 1 ORDER BY a", [("a", "P")], [])
    for stays in ("SELECT a FROM t WHERE a = <[Parameters].[P]> OR b = 1", "SELECT a FROM t WHERE (a = <[Parameters].[P]>)", "SELECT a FROM (SELECT * FROM t WHERE x = 1) WHERE a = <[Parameters].[P]>"):
        assert readers.lift_parameters(stays, ["a"]) == (stays, [], ["P"])
    assert readers.lift_parameters("SELECT a FROM t WHERE z = <[Parameters].[P]>", ["a"])[1:] == ([], ["P"])


def test_sql_lineage_and_names():
    assert readers.sql_tables("WITH q AS (SELECT * FROM dbo.[A b]) SELECT 'from x' FROM q JOIN s.t ON 1=1 -- from no") == ["dbo.Ab", "s.t"]
    assert readers.named_relation("[c].[s].[i]") == ("c", "s", "i") and readers.named_relation("i") == (None, None, "i")
    assert readers.storage_mode("postgres").score == 95 and readers.storage_mode("csv").mode == "import" and readers.storage_mode("odd", True).mode == "extract" and readers.storage_mode("odd").mode == "fallback"


def test_csv_is_padded_and_stays_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n1,2\n3,4,5,6\n")
    df = readers.read_csv(spark, str(tmp_path / "t.csv"), {"a": "x"})
    assert sorted(map(tuple, df.collect())) == [("1", "2", None), ("3", "4", "5")] and df.columns == ["x", "b", "c"]
    assert readers.read_csv(spark, str(tmp_path / "t.csv"), limit=1).count() == 1


def test_decimal_conventions(spark):
    for values, want in (([("1.234,5",), ("7,5",)], "comma"), ([("1,234.5",)], "dot"), ([("12",)], "unknown"), ([("1,5",), ("1.5",)], "unknown")):
        assert readers.decimal_convention(spark.createDataFrame(values, "v string"), ["v"]) == want
    df = spark.createDataFrame([("1.234,5",), ("x",)], "v string")
    assert [r[0] for r in df.select(readers.parse_number(F.col("v"), "comma")).collect()] == [1234.5, None]


def test_clean_names_and_csv_sink(spark, tmp_path):
    df = readers.clean_names(spark.createDataFrame([(1, 2, 3)], ["a b", "a.b", "(a b)"]))
    assert df.columns == ["a_b", "a_b_2", "a_b_3"]
    readers.write_csv(df, str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*.csv"))
    assert part.read_text(encoding="utf-8").startswith("﻿a_b")


def test_calendar_weeks(spark):
    df = spark.createDataFrame([("2020-12-27",), ("2021-01-10",)], "d string").select(F.to_date("d").alias("d"))
    days = {str(r.Date): r for r in calendar.calendar([(df, "d")]).collect()}
    assert len(days) == 366 + 365 and days["2021-01-02"].WeekOfYear == 1 and days["2021-01-03"].WeekOfYear == 2 and days["2021-01-03"].IsoYear == 2020 and days["2020-12-31"].WeekOfMonth == 5
    assert calendar.date_domain([(df, "d")]).count() == 15


def test_profile_and_reconcile(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 4.0), (3, None, 8.0)], "k long, g string, x double")
    stats = {r.column: r for r in profile.column_stats(df, frozenset({"k"})).collect()}
    assert stats["x"].null_rate == pytest.approx(0.3333) and stats["x"].avg == 6 and stats["g"].cardinality == 1 and "k" not in stats
    m = SemanticModel(spark).add("t", df)
    states = lambda a, b: {r.grouping: r.state for r in reconcile.reconcile(m, a, b, ["g"]).collect()}
    assert states("SUM([x])", "AVG([x]) * COUNT([x])") == {"(all)": "pass", "g": "pass"}
    assert states("COUNT([x])", "COUNT([k])") == {"(all)": "fail", "g": "fail"}
    assert list(reconcile.reconcile(m, "SUM([nope])", "1").collect()[0])[-1] == "inconclusive"
    assert reconcile.auto_grain(df, {"x"}, least=1) == ["g", "k"]
    a, b = (spark.createDataFrame(v, "measure string, value double") for v in ([("p", 1.0), ("q", 2.0)], [("p", 1.0), ("q", 3.0), ("r", 1.0)]))
    assert {r.measure: r.state for r in reconcile.against_expected(a, b).collect()} == {"p": "pass", "q": "fail", "r": "inconclusive"}
    assert reconcile.keep_better({"a": 1}, {"a": 1.5}) and not reconcile.keep_better({"a": 1, "b": 1}, {"a": 2, "b": 0.5})


def plain_score(left, right, weight):
    """The scoring rules over Python sets."""
    fields = lambda row: {cmp.token(f["name"]): f["type"] for f in row["fields"]}
    a, b = fields(left), fields(right)
    shared, union = set(a) & set(b), set(a) | set(b)
    na, nb = cmp.token(left["name"]), cmp.token(right["name"])
    wa, wb = set(cmp.name_tokens(left["name"])), set(cmp.name_tokens(right["name"]))
    name = 1.0 if na == nb else max(len(wa & wb) / len(wa | wb), (r if (r := difflib.SequenceMatcher(None, na, nb).ratio()) >= 0.6 else 0) * 0.9)
    column = sum(map(weight, shared)) / sum(map(weight, union))
    types = sum(b[x] in cmp.COMPATIBLE_TYPES[a[x]] for x in shared) / len(shared) if shared else 0.0
    keys = lambda row, n: {(cmp.connector(t["connector"]), cmp.token(t["database"]), cmp.token(t["name"]))[-n:] if n != 2 else (cmp.connector(t["connector"]), cmp.token(t["name"])) for t in row["tables"]}
    j = lambda x, y: len(x & y) / len(x | y)
    ta, tb = keys(left, 1), keys(right, 1)
    parts = {"name": round(name, 4), "column": round(column, 4), "type": round(types, 4)}
    if ta and tb:
        parts["source"] = round(max(j(keys(left, 3), keys(right, 3)), 0.85 * j(keys(left, 2), keys(right, 2)), 0.7 * (len(ta & tb) / len(ta))), 4)
    return sum(cmp.WEIGHTS[k] * v for k, v in parts.items()) / sum(cmp.WEIGHTS[k] for k in parts)


def test_scores_match_a_plain_version_and_ignore_order(spark):
    import math

    left, right = inventories(spark)
    rows = [r.asDict(recursive=True) for r in left.unionByName(right).collect()]
    df = {}
    for r in rows:
        for t in {cmp.token(f["name"]) for f in r["fields"]}:
            df[t] = df.get(t, 0) + 1
    n = len(rows)
    weight = lambda t: (0.25 if t in cmp.GENERIC_COLUMNS else 1.0) * max(0.15, min(1.0, math.log((n + 1) / (df[t] + 0.5)) / math.log(n + 1)))
    byid = {r["asset_id"]: r for r in rows}
    for shuffled in (left, left.orderBy(F.rand(7))):
        for r in cmp.compare(shuffled, right).collect():
            assert r.score == pytest.approx(plain_score(byid[r.l_asset_id], byid[r.r_asset_id], weight), abs=2e-4)


def test_names_in_any_script():
    assert cmp.token("Ｃａｆé [Straße]") == "cafestrasse" and cmp.token("売上 高") == "売上高" and cmp.name_tokens("The Data Source") == ["data", "source", "the"] and cmp.connector("Microsoft SQL Server") == "sqlserver"


def test_assignment_is_one_to_one(spark):
    pairs = cmp.compare(*inventories(spark))
    got = [tuple(r) for r in cmp.assign(pairs).collect()]
    left, right, want = set(), set(), []
    for a, b, s in sorted(((r.l_asset_id, r.r_asset_id, r.score) for r in pairs.where("score > 0").collect()), key=lambda r: (-r[2], r[0], r[1])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            want.append((a, b, s))
    assert sorted(got) == sorted(want)
    best = cmp.best_matches(pairs)
    assert cmp.rollup(best).agg(F.sum("n")).first()[0] == 4 and [r.asset_id for r in cmp.unmatched(inventories(spark)[1], best).collect()] == ["m4"]


def test_ranges_and_verdicts(spark):
    rows = [(0.0, 10.0, 0.0, 10.0, "equal"), (2.0, 5.0, 0.0, 10.0, "subset"), (0.0, 10.0, 2.0, 5.0, "superset"), (0.0, 5.0, 3.0, 10.0, "partial"), (0.0, 1.0, 2.0, 3.0, "disjoint"), (None, 1.0, 2.0, 3.0, "unknown")]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, want string")
    assert all(r.got == r.want for r in df.withColumn("got", verify.relationship(*map(F.col, "abcd"), rtol=0.01)).collect())
    assert verify.containment_verdict([("agree", None)]) == ("verified", "equal") and verify.containment_verdict([("directional", "right_ge"), ("agree", None)]) == ("compatible", "subset")
    assert verify.containment_verdict([]) == ("inconclusive", "unknown") and verify.plan_probes([("id", "int"), ("net", "real"), ("day", "date")], {"id"}, 2) == [("day", "date"), ("net", "real")]


def test_streams_agree_with_batches(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.write.parquet(str(tmp_path / "events"))
    name = "tumbled"
    q = stream.tumbling(stream.read_events(spark, str(tmp_path / "events"), 100), "1 day").writeStream.outputMode("complete").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.window_start, r.event_type, r.n) for r in spark.table(name).collect()) == sorted((r.window_start, r.event_type, r.n) for r in stream.tumbling(batch).collect())
    again = batch.unionByName(batch)
    assert stream.sessions(batch).agg(F.sum("n")).first()[0] == batch.count() and again.dropDuplicates(["event_id"]).count() == batch.count()


def chain(spark, n, width=12):
    """n assets that each share all columns but one with the next."""
    rows = [(f"a{i:02d}", "", [(f"col{k}x", "STRING") for k in range(i, i + width)], [], []) for i in range(n)]
    return spark.createDataFrame(rows, "asset_id string, name string, fields array<struct<name string, type string>>, tables array<struct<connector string, database string, name string>>, calcs array<string>")


def test_a_long_chain_is_one_cluster(spark):
    apart = chain(spark, 45).where("asset_id not in ('a42', 'a43')")  # a44 shares too little with a41
    got = {r.asset_id: (r.cluster_id, r["size"]) for r in cmp.cluster(apart).collect()}
    assert got == {**{f"a{i:02d}": ("a00", 42) for i in range(42)}, "a44": ("a44", 1)}


def test_two_target_lists_share_one_weight_table(spark):
    left, models = inventories(spark)
    published = chain(spark, 5).unionByName(left.where("asset_id = 's2'").withColumn("asset_id", F.lit("p2")))
    scored = cmp.compare_lists(left, models, published)
    scores = lambda df: {(r.l_asset_id, r.r_asset_id): r.score for r in df.collect()}
    assert scores(scored) == scores(cmp.compare(left, models.unionByName(published)))  # one document frequency over all assets
    assert scores(scored.where("target = 'model'")) != scores(cmp.compare(left, models))
    firsts = {(r.l_asset_id, r.target) for r in scored.where("rank = 1").collect()}
    assert firsts == {(f"s{i}", t) for i in range(1, 5) for t in ("model", "published")}
    copy = left.where("asset_id = 's2'").withColumns({"asset_id": F.lit("s0"), "name": F.lit("other"), "fields": F.slice("fields", 1, 3)})
    more = left.unionByName(copy)
    got = {r.cluster_id: r for r in cmp.cluster_scores(cmp.cluster(more), more, cmp.compare_lists(more, models, published.where("asset_id = 'p2'"))).collect()}
    assert got["s0"]["size"] == 2 and got["s0"].representative == "s0" and got["s0"].model_id == "m2" and got["s0"].published_id == "p2" and got["s0"].published_bucket == "already_exists"
    assert got["s1"].model_id == "m1" and got["s1"].published_tier == "None" or got["s1"].published_id is None
    none = {r.cluster_id: r for r in cmp.cluster_scores(cmp.cluster(left), left, cmp.compare_lists(left, models, published.where("false"))).collect()}
    assert none["s1"].published_id is None and none["s1"].published_tier is None and none["s1"].model_tier is not None


def test_field_diff(spark):
    schema = "asset_id string, name string, fields array<struct<name string, type string>>, tables array<struct<connector string, database string, name string>>, calcs array<string>"
    left = spark.createDataFrame([("s", "x", [("Order Ref", "STRING"), ("Amt", "REAL"), ("Old", "DATE"), ("amt", "STRING")], [("mysql", "d", "Orders"), ("mysql", "d", "Gone")], [])], schema)
    right = spark.createDataFrame([("m", "x", [("order_ref", "string"), ("AMT", "string"), ("New", "")], [("mysql", "d", "orders"), ("mysql", "d", "Added")], [])], schema)
    r = cmp.field_diff(cmp.compare(left, right), left, right).first()
    assert r.shared == ["Amt", "Order Ref"] and r.left_only == ["Old"] and r.right_only == ["New"] and [tuple(x) for x in r.type_mismatches] == [("Amt", "REAL", "string")]
    assert r.shared_tables == ["orders"] and r.left_only_tables == ["gone"] and r.right_only_tables == ["added"] and r.source_compared


def test_asof_join_edges(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 9), (5, "a", None), (6, "a", 5)], "id long, k string, at int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 5, "z"), ("b", 10, "w"), (None, 1, "n"), ("a", None, "m")], "rk string, rat int, v string")
    got = {r.id: r.v for r in relationships.asof_join(left, right, [("k", "rk")], ("at", "rat")).collect()}
    assert got == {1: "z", 2: None, 3: None, 4: None, 5: None, 6: "z"}
    assert relationships.asof_join(left.where("false"), right, [("k", "rk")], ("at", "rat")).count() == 0


def test_batched_profile_names_the_columns_at_fault(spark):
    from pyspark.errors import PySparkException

    df = spark.createDataFrame([(1, 2.0, "x"), (3, None, "x")], "a long, b double, c string")

    def shaky(part):
        if "b" in part.columns:
            raise PySparkException("no answer")
        return profile.column_stats(part)

    found, failed = profile.profile_in_batches(df, 3, shaky)
    assert failed == ["b"] and {r.column: (r.non_null, r.cardinality) for r in found.collect()} == {"a": (2, 2), "c": (2, 1)}
    whole, none = profile.profile_in_batches(df, 2)
    assert not none and sorted(map(str, whole.collect())) == sorted(map(str, profile.column_stats(df).collect()))


def test_ranges_too_long_are_refused(spark):
    with pytest.raises(Unsupported):
        SemanticModel(spark).parameter("P", 1, low=0, high=100_000, step=1).parameters["P"].domain(spark)
