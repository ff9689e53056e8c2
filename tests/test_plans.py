import json

import pytest
from stagelens.plans import details, parser
from stagelens.plans.text import call, listed, ordering, orderings, split_top
from stagelens.plans.tree import NODE_TYPES, parse_tree, tree_lines
from stagelens.queries.plans import JOIN_INFO, JOIN_PLAN


def test_lists_are_split_outside_brackets():
    assert listed("[a#1, f(b#2, c#3) AS d#4, e#5]") == ["a#1", "f(b#2, c#3) AS d#4", "e#5"]
    assert listed("[]") is None and listed(None) is None
    assert split_top("struct<a:int,b:int>, x -> y, a >= b, c") == ["struct<a:int,b:int>", "x -> y", "a >= b", "c"]


def test_calls_and_orders():
    assert call("count(1)") == {"function": "count", "col": "1"}
    assert call("row_number()") == {"function": "row_number", "col": None}
    assert ordering("a#1 DESC NULLS LAST") == {"name": "a#1", "asc": False, "nulls_first": False}
    assert [x["asc"] for x in orderings("[a ASC NULLS FIRST, b DESC NULLS LAST]")] == [True, False]


def test_tree_keeps_the_final_plan_only():
    nodes = parse_tree(tree_lines(JOIN_PLAN))
    assert list(nodes) == [13, 12, 5, 4, 3, 2, 1, 11, 10, 9, 8, 7]
    assert nodes[12].children == [5, 11] and nodes[13].children == [12]


def test_tree_of_nested_adaptive_plans():
    lines = """AdaptiveSparkPlan (9)
+- == Final Plan ==
   * Filter (4)
   +- InMemoryTableScan (3)
         +- InMemoryRelation (2)
               +- AdaptiveSparkPlan (8)
                  +- == Final Plan ==
                     * Range (1)
                  +- == Initial Plan ==
                     Range (7)
+- == Initial Plan ==
   Filter (6)""".split("\n")
    nodes = parse_tree(lines)
    assert list(nodes) == [4, 3, 2, 8, 1] and nodes[8].children == [1]


def test_two_roots_are_refused():
    with pytest.raises(ValueError, match="one root"):
        parse_tree(["Filter (1)", "Project (2)"])


def test_unknown_operators():
    assert parse_tree(["Mystery (1)"])[1].node_type == "Unknown"
    with pytest.raises(ValueError, match="Unknown node type"):
        parse_tree(["Mystery (1)"], strict=True)
    assert parse_tree(["Execute InsertIntoHadoopFsRelationCommand (12345)"])[12345].node_type == "InsertIntoHadoopFsRelationCommand"


def rows():
    return {r["node_id"]: r for r in parser.parse_plan(JOIN_PLAN, JOIN_INFO)}


def test_plan_rows():
    r = rows()
    assert r[12]["whole_stage_codegen_id"] == 4 and r[100_004]["node_type"] == "WholeStageCodegen"
    assert all(r[i]["accumulators"] for i in (1, 2, 5, 7, 8, 12))
    d = json.loads(r[1]["details"])["detail"]
    assert d["location"]["location"] == ["/data/t"] and d["pushed_filters"] == ["IsNotNull(a)", "In(b, [x,y])"]
    assert json.loads(r[9]["details"])["detail"]["arguments"] == {"partitioning": "rangepartitioning", "partition_cols": ["id#3L"], "n_partitions": 8, "exchange_type": "REPARTITION_BY_COL", "plan_identifier": 12}
    assert json.loads(r[4]["details"])["detail"]["arguments"] == "coalesced and skewed"
    assert json.loads(r[11]["details"])["detail"]["arguments"]["global_sort"] is True
    assert json.loads(r[7]["details"])["detail"]["n_partitions"] == 2


CASES = {
    "Window": (["Input [2]: [p#1, o#2]", "Arguments: [row_number() windowspecdefinition(p#1, o#2 DESC NULLS LAST, specifiedwindowframe(RowFrame, unboundedpreceding$(), currentrow$())) AS rn#3, sum(o#2) windowspecdefinition(p#1, specifiedwindowframe(RowFrame, unboundedpreceding$(), unboundedfollowing$())) AS s#4], [p#1], [o#2 DESC NULLS LAST]"],
               lambda d: (d["arguments"]["window_function"]["function"], len(d["arguments"]["window_functions"]), d["arguments"]["window_specification"]["partition_cols"], d["arguments"]["window_specification"]["order_cols"][0]["asc"]), ("row_number", 2, ["p#1"], False)),
    "WindowGroupLimit": (["Input [1]: [p#1]", "Arguments: [p#1], [o#2 ASC NULLS FIRST], rank(o#2), 3, Partial"], lambda d: (d["arguments"]["limit"], d["arguments"]["processing_stage"], d["arguments"]["order_cols"][0]["nulls_first"]), (3, "Partial", True)),
    "TakeOrderedAndProject": (["Input [1]: [a#1]", "Arguments: 10, [a#1 ASC NULLS FIRST], [a#1]"], lambda d: (d["arguments"]["limit"], d["arguments"]["output"]), (10, ["a#1"])),
    "BroadcastExchange": (["Input [1]: [a#1]", "Arguments: HashedRelationBroadcastMode(List(input[0, string, false]),true), [plan_id=7]"], lambda d: (d["arguments"]["mode"], d["arguments"]["nullable"], d["arguments"]["plan_identifier"]), ("HashedRelationBroadcastMode", True, 7)),
    "Exchange": (["Input [1]: [a#1]", "Arguments: RoundRobinPartitioning(3), REPARTITION_BY_NUM, [plan_id=9]"], lambda d: (d["arguments"]["partition_cols"], d["arguments"]["n_partitions"]), (None, 3)),
    "InsertIntoHadoopFsRelationCommand": (["Input [1]: [a#1]", "Arguments: file:/out/t, false, CSV, [header=true, path=/out/t], Overwrite, [a]"], lambda d: (d["arguments"]["file_path"], d["arguments"]["mode"], d["arguments"]["options"][0], d["arguments"]["output"]), ("/out/t", "Overwrite", {"key": "header", "value": "true"}, ["a"])),
    "Generate": (["Input [1]: [a#1]", "Arguments: explode(a#1), [], true, [c#2]"], lambda d: (d["arguments"]["generator"], d["arguments"]["include_nulls"], d["arguments"]["output"]), ("explode(a#1)", True, ["c#2"])),
    "Expand": (["Input [1]: [a#1]", "Arguments: [[a#1, 0], [null, 1]], [a#2, g#3]"], lambda d: (d["projections"], d["output"]), ([["a#1", "0"], ["null", "1"]], ["a#2", "g#3"])),
    "HashAggregate": (["Input [1]: [a#1]", "Keys [1]: [a#1]", "Functions [2]: [partial_sum(a#1), count(1)]", "Aggregate Attributes [1]: [s#2]", "Results [1]: [s#2]"], lambda d: [f["function"] for f in d["functions"]], ["partial_sum", "count"]),
    "BroadcastHashJoin": (["Left keys [1]: [a#1]", "Right keys [1]: [b#2]", "Join type: LeftOuter", "Join condition: (a#1 > b#2)"], lambda d: (d["join_type"], d["join_condition"]), ("LeftOuter", "(a#1 > b#2)")),
    "GlobalLimit": (["Input: []", "Arguments: 5, 2"], lambda d: (d["input"], d["arguments"]), (None, {"limit": 5, "offset": 2})),
    "Sample": (["Input [1]: [a#1]", "Arguments: 0.0, 0.5, false, 42"], lambda d: (d["upper_bound"], d["with_replacement"], d["seed"]), (0.5, False, 42)),
    "WriteToDataSourceV2": (["WriteOptions: [a=1, b=2]"], lambda d: d["write_options"], {"a": "1", "b": "2"}),
    "FlatMapGroupsInPandas": (["Input [1]: [a#1]", "Arguments: [a#1], f(a#1)#2, [b#3]"], lambda d: d["grouping_keys"], ["a#1"]),
    "LocalTableScan": (["Output [1]: [a#1]", "Arguments: <empty>, [a#1]"], lambda d: d["arguments"], {"contents": "<empty>", "input": ["a#1"]}),
}


@pytest.mark.parametrize("kind", sorted(CASES))
def test_details(kind):
    lines, look, want = CASES[kind]
    found = details.detail(kind, details.Block(f"(1) {kind}", lines), strict=True)
    assert look(found) == want


def test_every_operator_but_four_has_readers():
    assert set(NODE_TYPES) - set(details.READERS) == {"Union", "WholeStageCodegen", "CollectLimit", "Unknown"}


def test_odd_details_stay_as_text():
    assert details.detail("Exchange", details.Block("(1) Exchange", ["Arguments: nothing known"])) == {"raw": "(1) Exchange\nArguments: nothing known"}
    with pytest.raises(ValueError, match="Failed"):
        details.detail("Exchange", details.Block("(1) Exchange", []), strict=True)
