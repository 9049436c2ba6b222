"""Requests on literal frames: table calculations, levels of detail, NULL rules, order of operations, refusals."""

import datetime as dt

import pytest

from tessera.operators import relationships as rel
from tessera.operators.swaps import swap_field
from tessera.plans.errors import Unsupported
from tessera.plans.model import SemanticModel
from tessera.plans.query import run_request


@pytest.fixture(scope="module")
def model(spark):
    marks = spark.createDataFrame([(1, "a", 6.0), (1, "b", 9.0), (1, "c", 9.0), (1, "d", 14.0), (2, "e", 5.0), (2, "f", None), (None, "g", 2.0)], "p long, m string, x double")
    customers = spark.createDataFrame([(1, "N"), (2, None)], "cust long, area string")
    orders = spark.createDataFrame([(10, 1, dt.date(2024, 1, 5)), (11, 1, dt.date(2024, 2, 5)), (12, 2, dt.date(2024, 2, 6)), (13, 9, dt.date(2025, 1, 1))], "ord long, o_cust long, day date")
    lines = spark.createDataFrame([(10, 1.0), (10, 2.0), (11, 4.0), (12, 8.0), (12, 16.0), (13, 32.0), (13, None)], "l_ord long, q double")
    m = SemanticModel(spark, anchor=dt.date(2024, 2, 15)).add("marks", marks).add("customers", customers).add("orders", orders).add("lines", lines)
    m.relate("lines", "l_ord", "orders", "ord", measure=True).relate("orders", "o_cust", "customers", "cust", measure=True)
    m.parameter("Top", 3).calc("Total", "SUM([q])").calc("Twice", "[Total] * 2").calc("Row", "[q] + 1")
    return m


def ask(model, fields, **more):
    return [tuple(r) for r in run_request(model, {"fields": fields, **more}).collect()]


def c(formula, name, **more):
    return {"calculation": formula, "fieldAlias": name, **more}


P, M = {"fieldCaption": "p"}, {"fieldCaption": "m"}


def test_ranks_and_nulls(model):
    kinds = [("RANK", [4, 2, 2, 1, 1, None, 1]), ("RANK_DENSE", [3, 2, 2, 1, 1, None, 1]), ("RANK_MODIFIED", [4, 3, 3, 1, 1, None, 1]), ("RANK_UNIQUE", [4, 2, 3, 1, 1, None, 1])]
    for kind, want in kinds:
        got = ask(model, [P, M, c(f"{kind}(SUM([x]))", "r", address=["m"])])
        assert [r[2] for r in sorted(got, key=lambda r: r[1])] == want, kind
    got = dict((r[1], r[2]) for r in ask(model, [P, M, c("RANK_PERCENTILE(SUM([x]))", "r", address=["m"])]))
    assert got["a"] == 0 and got["b"] == got["c"] == pytest.approx(2 / 3) and got["d"] == 1 and got["e"] == 0 and got["f"] is None


def test_running_last_equals_window_and_union_of_filter_and_exclude(model):
    rows = ask(model, [M, c("RUNNING_SUM(SUM([x]))", "r"), c("WINDOW_SUM(SUM([x]))", "w"), c("RUNNING_COUNT(SUM([x]))", "n")])
    last = max(rows)
    assert last[1] == last[2] == 45 and last[3] == 6
    keep = ask(model, [M], filters=[{"field": P, "filterType": "SET", "values": [1]}])
    drop = ask(model, [M], filters=[{"field": P, "filterType": "SET", "values": [1], "exclude": True}])
    assert sorted(keep + drop) == [(x,) for x in "abcdefg"]


def test_fixed_at_view_grain_is_the_plain_aggregate_and_null_is_a_member(model):
    rows = ask(model, [P, c("SUM([x])", "a"), c("MAX({FIXED [p] : SUM([x])})", "b"), c("COUNT([x])", "n")])
    assert sorted(rows, key=str) == sorted([(1, 38.0, 38.0, 4), (2, 5.0, 5.0, 1), (None, 2.0, 2.0, 1)], key=str)


def test_joins_keep_fact_rows_and_never_fan_out(model):
    assert ask(model, [{"fieldCaption": "area"}, c("[Twice]", "t"), c("COUNTD([ord])", "n")]) and dict((r[0], r[1:]) for r in ask(model, [{"fieldCaption": "area"}, c("[Twice]", "t"), c("COUNTD([ord])", "n")])) == {"N": (14.0, 2), None: (112.0, 2)}
    assert ask(model, [c("COUNT([ord])", "n")]) == [(4,)]
    assert ask(model, [c("SUM([Row])", "s")]) == [(69.0,)]


def test_mark_filters_come_last(model):
    hide = {"field": {"calculation": "INDEX()", "address": ["m"], "partition": []}, "filterType": "QUANTITATIVE_NUMERICAL", "quantitativeFilterType": "MIN", "min": 7}
    assert ask(model, [P, M, c("RUNNING_SUM(SUM([x]))", "r", address=["m"], partition=[])], filters=[hide]) == [(None, "g", 45.0)]


def test_relative_dates_use_the_anchor(model):
    f = {"field": {"fieldCaption": "day"}, "filterType": "DATE", "periodType": "MONTHS", "dateRangeType": "CURRENT"}
    assert ask(model, [c("COUNT([ord])", "n")], filters=[f]) == [(2,)]


def test_limits_sorts_and_rounding(model):
    rows = ask(model, [M, c("AVG([x]) / 3", "a", maxDecimalPlaces=1, sortDirection="DESC")], limit=2)
    assert rows == [("d", 4.7), ("b", 3.0)]


def test_row_security_fails_closed(spark):
    m = SemanticModel(spark).add("t", spark.createDataFrame([("ann", 1), ("bob", 2)], "who string, v long"))
    m.secure("t", "[who] = USERNAME()")
    assert ask(m, [{"fieldCaption": "v"}], user="bob") == [(2,)] and ask(m, [{"fieldCaption": "v"}]) == []
    m.secure("t", "ISMEMBEROF('x') OR TRUE")
    assert ask(m, [{"fieldCaption": "v"}], user="bob") == []


def test_names(spark):
    m = SemanticModel(spark).add("a", spark.createDataFrame([(1, 2)], "id long, Left long")).add("b", spark.createDataFrame([(1, 2)], "id long, other long"))
    assert m.locate("left") == ("a", "Left") and m.locate("id", {"b"}) == ("b", "id") and m.locate("a.id") == ("a", "id")
    with pytest.raises(Unsupported, match="id"):
        m.locate("id")
    assert "did you mean other" in m.check("SUM([othr])")[0]
    m.calc("x", "[y]").calc("y", "[x]").calc("z", "SUM([Left])").calc("zz", "[z] + 1")
    assert m.dependency_order() == [["z"], ["zz"]] and not m.is_row_level("zz")
    with pytest.raises(Unsupported, match="itself"):
        ask(m, [{"fieldCaption": "x"}])
    with pytest.raises(Unsupported, match="reaches"):
        ask(m, [{"fieldCaption": "Left"}, {"fieldCaption": "other"}])


@pytest.mark.parametrize(
    "fields,category",
    [
        ([c("SUM([x]) + [x]", "v")], "missing_outer_aggregation"), ([c("SUM(SUM([x]))", "v")], "type_or_shape_mismatch"), ([c("RUNNING_SUM(SUM([x]))", "v")], "missing_addressing_intent"), ([c("SUM([m])", "v")], "type_or_shape_mismatch"), ([c("SUM([x]) + [Parameters].[None]", "v")], "model_object_parameter"),
        ([c("[nothing]", "v")], "unresolved_reference"), ([c("PREVIOUS_VALUE(1)", "v")], "missing_addressing_intent"), ([P, c("RUNNING_SUM(PREVIOUS_VALUE(SUM([x])))", "v")], "language_gap"), ([P, c("SUM([x])", "v", scope="Elsewhere")], "missing_addressing_intent"), ([P, c("SUM([x])", "v", address=["m"])], "missing_addressing_intent"), ([c("{INCLUDE [m] : SUM([x])}", "v")], "missing_outer_aggregation"), ([c("MAX({FIXED [p], [m] : AVG({FIXED [p] : SUM([x])})})", "v")], "type_or_shape_mismatch"), ([P, P], "type_or_shape_mismatch"),
    ],
)
def test_refusals(model, fields, category):
    with pytest.raises(Unsupported) as e:
        ask(model, fields)
    assert e.value.category == category


def test_paths_keys_and_swaps(model, spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d")]
    assert rel.unique_path(edges, "a", "d") == ["a", "b", "c", "d"]
    for bad in ([*edges, ("a", "d")], [*edges, ("b", "c")], [("a", "b")]):
        with pytest.raises(Unsupported):
            rel.unique_path(bad, "a", "d")
    for far in ([*edges, ("a", "p"), ("p", "q"), ("q", "r"), ("r", "t"), ("t", "d")], [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f")]):
        with pytest.raises(Unsupported):  # a longer second path, and one path that is too long
            rel.unique_path(far, "a", "f" if len(far) == 5 else "d")
    with_calendar = [*edges, ("a", "Calendar"), ("d", "Calendar")]
    assert rel.unique_path(with_calendar, "a", "d", hubs=frozenset({"Calendar"})) == ["a", "b", "c", "d"] and rel.unique_path(with_calendar, "a", "Calendar", hubs=frozenset({"Calendar", "d"})) == ["a", "Calendar"]
    assert [rel.connection_mix(k) for k in ({"a": "file"}, {"a": "file", "b": "file"}, {"a": "file", "b": "postgres"}, {"a": "postgres", "b": "postgres"}, {"a": "postgres", "b": "mysql"})] == ["single", "several_files", "file_and_live", "single", "several_live"]
    assert rel.forest_edges([("a", "b"), ("b", "c"), ("a", "c")]) == [("a", "b"), ("b", "c")]
    assert rel.looks_like_identity("Orders", "Order_ID") and not rel.looks_like_identity("Orders", "Sales")
    assert rel.cardinality(spark.createDataFrame([(1,), (1,)], "k long"), "t", "k")[0] == "many_to_many" and rel.confidence("measured", True) == "high"
    model.parameter("Pick", "b")
    assert swap_field(model, "CASE [Parameters].[Pick] WHEN 'a' THEN [p] WHEN 'b' THEN [m] WHEN 'n' THEN NULL END") == "m"
    with pytest.raises(Unsupported):
        swap_field(model, "IF [x] > 1 THEN [p] END")
