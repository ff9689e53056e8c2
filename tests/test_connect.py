from types import SimpleNamespace as N

import pytest
from stagelens.operators import detect
from stagelens.sources import connect as C


def node(i, parent, name, *metrics):
    return N(plan_id=i, parent_plan_id=parent, name=name, metrics=[N(name=a, value=b, metric_type=c) for a, b, c in metrics])


ANSWER = [
    node(1, 1, "PhotonResultStage", ("cumulTime", 3_000_000_000, "nsTiming")),
    node(2, 1, "BroadcastHashJoin [a#1, b#2L], [c#3, d#4], LeftOuter, BuildRight", ("numOutputRows", 100, "sum"), ("size", 2048, "size")),
    node(3, 2, "PhotonScan parquet main.t [a#1]", ("numOutputRows", 10, "sum")),
    node(4, 2, "PhotonScan parquet main.u[c#3]", ("numOutputRows", 20, "sum"), ("cumulTime", 60_000_000_000, "nsTiming")),
]


class Relation:
    def __init__(self, kind, **inner):
        self.kind = kind
        setattr(self, kind, N(**inner))

    def WhichOneof(self, _):
        return self.kind


class Client:
    def _build_metrics(self, proto):
        return proto

    def to_table(self, plan):
        return plan


def captured(spark, answers, plan=None):
    client = Client()
    with C.ConnectCapture(N(_client=client), "job") as got:
        for a in answers:
            client._build_metrics(a)
        if plan:
            client.to_table(N(root=plan, HasField=lambda _: True))
    assert "_build_metrics" not in vars(client) or client._build_metrics(1) == 1
    return got.dag(spark)


def test_relation_and_detectors(spark):
    rows = {r.node_id: r for r in captured(spark, [ANSWER, []]).collect()}
    assert (rows[1].node_type, rows[1].child_nodes, rows[2].child_nodes, rows[3].child_nodes) == ("ResultQueryStage", "2", "4, 3", None)
    assert rows[1].query_duration_seconds == 3.0 and rows[4].node_duration_minutes == 1.0 and rows[2].accumulator_totals[1].readable_str == "2.0 KiB"
    (r,) = detect.find_row_explosions(captured(spark, [ANSWER])).collect()
    assert (r.join_type, r.left_keys, r.right_keys, r.ratio, r.right_scan_paths) == ("LeftOuter", ["a", "b"], ["c", "d"], 5.0, ["main.t"])


def test_logical_joins_come_first(spark):
    leaf = Relation("read")
    plan = Relation("project", input=Relation("join", using_columns=["k"], join_type=7, left=leaf, right=Relation("join", using_columns=["m"], join_type=1, left=leaf, right=leaf)))
    assert [j["join_type"] for j in C.logical_joins(plan)] == ["Cross", "Inner"]
    (r,) = detect.cartesian_joins(captured(spark, [ANSWER], plan)).collect()
    assert '"left_keys":["k"]' in r.details


def test_names(spark):
    assert C.joins_in_name("SortMergeJoin [a#1], [b#2], Inner") == {"left_keys": ["a"], "right_keys": ["b"], "join_type": "Inner"}
    with pytest.raises(ValueError, match="Mystery"):
        captured(spark, [[node(1, 1, "Mystery x")]])
    assert captured(spark, []).count() == 0
