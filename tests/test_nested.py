import json

import pytest

from ledgerline.operators import nested
from ledgerline.operators.nested import flat_children, label_nodes, node_table, numbered


def test_labels_contain_their_descendants():
    nodes = label_nodes('{"a": [{"b": 1}, {"b": [2, 3]}], "c": null}')
    by = {(n[4], n[5], n[0]): n for n in nodes}
    root = nodes[0]
    assert all(root[0] < n[0] and n[1] < root[1] for n in nodes[1:])
    first, second = [n for n in nodes if n[4] == "a[]"]
    inner = [n for n in nodes if n[4] == "a[].b[]"]
    assert all(second[0] < n[0] and n[1] < second[1] and not (first[0] < n[0] and n[1] < first[1]) for n in inner)
    assert len(by) == len(nodes)


def test_damaged_and_deep():
    assert label_nodes(None) is None and label_nodes("") is None and label_nodes('{"a": [1,') is None and label_nodes('{"a": NaN}') is None
    assert label_nodes("7")[0][6:] == ("number", "7")
    deep = "[" * 400 + "]" * 400
    assert len(label_nodes(deep)) == 400
    assert [n[4] for n in label_nodes('{"x.y": {"z[": 1}}')] == ["", "x\\.y", "x\\.y.z\\["]


def rows(spark, payloads):
    df = spark.createDataFrame([(i, "kind", p) for i, p in enumerate(payloads)], "raw_id bigint, path string, payload string")
    return sorted(tuple(r) for r in flat_children(df).collect())


def test_children(spark):
    sub = lambda acc, form: json.dumps({"filings": {"recent": {"accessionNumber": acc, "form": form}}, "x": [1]})
    bench = lambda cases: json.dumps({"numeric_cases": cases})
    got = rows(spark, [
        sub(["a", None, "c"], ["10-K"]), sub("solo", "8-K"), sub(["a"], None), sub(None, ["10-K"]),
        bench([{"case_id": "k", "expected_facts": [{"concept": "r"}, {"concept": None}, {"v": 1}, 5, {"concept": "s"}]}, {"expected_facts": {"concept": "t"}}]),
        bench({"case_id": None, "expected_facts": {"concept": "u"}}), bench(3), "[1, 2]", "null", '{"filings": {"recent": {"accessionNumber": ["a"', None, "",
    ])
    assert got == sorted([
        (0, -1, 0, "a", "10-K"), (0, -1, 2, "c", ""), (1, -1, 0, "solo", "8-K"), (2, -1, 0, "a", ""),
        (4, 0, 0, "k", "r"), (4, 0, 4, "k", "s"), (4, 1, 0, "", "t"), (5, 0, 0, "", "u"),
    ])


def test_repeated_ids_stay_apart_and_empty_table(spark):
    p = json.dumps({"filings": {"recent": {"accessionNumber": ["a"], "form": ["4"]}}})
    df = spark.createDataFrame([(1, p), (1, p)], "raw_id bigint, payload string")
    assert [tuple(r) for r in flat_children(df).collect()] == [(1, -1, 0, "a", "4")] * 2
    assert flat_children(df.where("false")).count() == 0


def test_node_table_keeps_named_paths(spark):
    df = numbered(spark.createDataFrame([(1, '{"a": {"b": [1, 2]}}')], "record_id bigint, payload string"))
    assert [(r.pos, r.value) for r in node_table(df, "payload", "a.b[]").orderBy("pos").collect()] == [(0, "1"), (1, "2")]


def test_payloads_deeper_than_the_parser_allows():
    depth = 3000  # of 12,000 levels in all; plain json gives up at about 10,000
    nodes = nested.label_nodes('{"a": ' * depth + "[1, " + "[" * 9000 + ' "x" ' + "]" * 9000 + "]" + "}" * depth)
    assert len(nodes) == depth + 1 + 1 + 9000 + 1 and nodes[-1][-1] == "x" and nodes[-1][3] == depth + 9001
    assert nested.label_nodes("[" * 20000 + "]" * 19999) is None


def test_deep_parser_agrees_with_the_plain_one():
    good = ['{"a": [1, -2.5e3, "x\\n", null, true], "b": {}, "a": []}', " [ ] ", "3", '"s"', '[[[{"k" : [ {} , {"z":0} ]}]]]']
    for x in good:
        assert nested.loads_deep(x) == json.loads(x)
    for x in ["", "[", "[1,]", '{"a"}', '{"a":1,}', "[1 2]", "[]]", "{1:2}", "[NaN]", '{"a":1]', "[1}", "tru"]:
        with pytest.raises(ValueError):
            nested.loads_deep(x)


def test_nodes_nested_in_nodes_of_another_path_find_the_innermost_that_holds_them(spark):
    """A node after an inner one has closed still finds the outer one."""
    text = '{"a": [{"a": {"x": 1}, "x": 2}, {"x": 3}], "x": 4}'
    df = numbered(spark.createDataFrame([(1, text)], "record_id bigint, payload string"))
    rows = nested.linked_nodes(df, "payload", ("a[].a.x", "a[].x", "x"), ("a[]", "a[].a")).collect()
    pre = {n[4] + str(n[5]): n[0] for n in nested.label_nodes(text)}
    assert sorted((r.value, r.parent_pre) for r in rows) == [("1", pre["a[].aNone"]), ("2", pre["a[]0"]), ("3", pre["a[]1"])]
