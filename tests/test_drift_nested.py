import json

import pyspark.sql.functions as F
from pyspark.sql import Row

from spotframe.operators import drift, nested

LINE = "file_name string, stream string, series string, line_no int, received_at timestamp_ntz, payload string"


def lines(spark, files):
    rows = []
    for stamp, recs in files:
        for i, r in enumerate(recs):
            rows.append((f"s_x_2021010{stamp}T000000Z.jsonl", "s", "x", i + 1, None, r if r is None or isinstance(r, str) else json.dumps(r)))
    return spark.createDataFrame(rows, LINE)


def changes(spark, files):
    log = drift.changes(drift.file_catalogue(lines(spark, files)))
    return {(r.file_name[11], r.change, r.old_path, r.new_path) for r in log.collect()}


def test_all_kinds_of_change(spark):
    one = [{"rec": i, "a": i * 1.5, "b": {"c": "x"}, "t": i, "gone": 1} for i in range(1, 6)]
    two = [{"rec": i, "a2": i * 1.5, "b": {"c": "x"}, "t": str(i), "new": True} for i in range(4, 9)]
    assert changes(spark, [(1, one), (2, two)]) == {("2", "renamed", "a", "a2"), ("2", "type", "t", "t"), ("2", "removed", "gone", ""), ("2", "added", "", "new")}


def test_no_overlap_is_no_rename_and_rare_fields_do_not_count(spark):
    one = [{"rec": i, "a": 1} for i in range(20)] + [{"rec": 99, "a": 1, "rare": 2}]
    two = [{"rec": i, "b": 1} for i in range(50, 60)]
    assert changes(spark, [(1, one), (2, two)]) == {("2", "removed", "a", ""), ("2", "added", "", "b")}


def test_broken_empty_repeated_lines_and_map_keys(spark):
    one = [{"rec": 1, "next_params": {"k": 1}, "n": None}, "{broken", "", None, "[1]", {"rec": 2, "next_params": {"z": 1}, "n": None}]
    df = lines(spark, [(1, one), (1, one)])
    parsed = drift.parsed_lines(df)
    assert parsed.count() == 6 and parsed.where("readable").count() == 2
    schema = {(r.path, r.type) for r in drift.file_catalogue(df)["schema"].collect()}
    assert schema == {("rec", "number"), ("next_params", "map"), ("n", "null")}


def test_lifespans_have_islands(spark):
    base = lambda i, k: [{"rec": i, **({"f": 1} if k else {}), "g": 1}]
    spans = drift.lifespans(drift.file_catalogue(lines(spark, [(1, base(1, 1)), (2, base(2, 0)), (3, base(3, 1))]))).where("path = 'f'")
    assert sorted((r.from_seq, r.to_seq, r.starts, r.ends) for r in spans.collect()) == [(1, 1, False, True), (3, 3, True, False)]


def test_consistent_table_brings_names_and_types_together(spark):
    one = [{"rec": i, "family": f"f{i}", "score": i / 2, "once": 1} for i in range(1, 6)]
    two = [{"rec": i, "kind": f"f{i}", "score": [i / 2]} for i in range(4, 9)]
    three = [{"rec": i, "kind": f"f{i}", "score": str(i / 2)} for i in range(8, 12)]
    t = drift.consistent_table(lines(spark, [(1, one), (2, two), (3, three)]), "s")
    assert {(r.rec, r.family, r.score) for r in t.collect()} == {(i, f"f{i}", i / 2) for i in range(1, 12)}


def test_no_value_is_lost(spark):
    recs = [{"rec": i, "n": i, "b": True, "t": "x"} for i in range(1, 8)] + [{"rec": 8, "n": "abc", "b": "maybe", "t": [1, 2], "rare": {"deep": None, "er": 5}}, {"rec": 9, "n": "7.5", "b": "yes"}]
    two = [{"rec": i, "m": i, "b": True} for i in [5, 6, 7, *range(30, 45)]] + [{"rec": 20, "m": 1, "n": 2}]
    t = {r.rec: r for r in drift.consistent_table(lines(spark, [(1, recs), (2, two)]), "s").collect()}
    assert (t[8].n, t[8].b, t[8].extra) == (None, None, {"n": '"abc"', "b": '"maybe"'}) and t[8].t == "[1,2]" and t[8].rare_er == 5.0
    assert (t[9].n, t[9].b, t[9].extra) == (7.5, True, {})
    assert (t[20].n, t[20].extra) == (1.0, {"n": "2"}) and t[5].n == 5.0


def test_names_beyond_the_table_go_to_extra(spark):
    df = lines(spark, [(1, [{"rec": 1, "a": 1, "b": 2, "c": 3}])])
    catalogue = drift.file_catalogue(df)
    assert len(drift.alias_table(catalogue, drift.changes(catalogue), most=2)) == 2


def test_rejected_lines(spark):
    df = lines(spark, [(1, [{"rec": 1}, "{broken", " ", None, "[1]", {"x": 1}, {"rec": "7"}]), (1, [{"rec": 1}, {"rec": 2}, "", None, "[1]", {"x": 1}, {"rec": "7"}])])
    assert {(r.line_no, r.reason) for r in drift.rejected_lines(df).collect()} == {(3, "empty"), (4, "empty"), (5, "broken"), (6, "no record number"), (7, "no record number")}


def test_dotted_and_nested_spelling_of_one_path(spark):
    df = lines(spark, [(1, ['{"rec": 1, "a.b": 1, "a": {"b": 2}}', '{"rec": 2, "a.b": 1, "a.b": 3}'])])
    assert {(r.rec, r.a_b) for r in drift.consistent_table(df, "s").collect()} == {(1, 2.0), (2, 3.0)}


def test_empty_log(spark):
    empty = lines(spark, [])
    assert drift.changes(drift.file_catalogue(empty)).count() == 0
    assert drift.consistent_table(empty, "s").count() == 0


SCHEMA = "id long, score double, m struct<p:struct<t:double,w:boolean>,tags:array<string>>, trials array<struct<n:int,p:struct<t:double,w:boolean>,cells:array<struct<c:int,flags:array<string>>>>>"


def records(spark):
    return spark.createDataFrame(
        [
            (1, 0.5, ((1.0, None), ["a", None]), [(1, (2.0, True), [(7, ["x"]), None, (8, [])]), None, (2, None, None)]),
            (2, None, None, None),
            (3, 1.0, ((None, None), []), []),
        ],
        SCHEMA,
    )


def test_flat_tables_keep_positions_and_links(spark):
    t = nested.flat_tables(records(spark), "id", inherit={"p_shape": "trials"})
    assert set(t) == {"", "m_tags", "trials", "trials_cells", "trials_cells_flags"}
    assert sorted((r.id, r.trials_pos, r.shape) for r in t["trials"].collect()) == [(1, 0, "{n,p:{t,w},cells:n}"), (1, 1, "0"), (1, 2, "{n}")]
    assert sorted((r.id, r.trials_pos, r.cells_pos, r.c, r.trials_p_shape) for r in t["trials_cells"].where("shape <> '0'").collect()) == [(1, 0, 0, 7, "{t,w}"), (1, 0, 2, 8, "{t,w}")]
    assert [(r.id, r.tags_pos, r.value) for r in t["m_tags"].orderBy("tags_pos").collect()] == [(1, 0, "a"), (1, 1, None)]
    assert {r.id: r.m_shape for r in t[""].collect()} == {1: "{p:{t},tags:n}", 2: "0", 3: "{p:{},tags:e}"}


def test_records_can_be_put_together_again(spark):
    t = nested.flat_tables(records(spark), "id")
    cells = t["trials_cells"].groupBy("id", "trials_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("cells_pos", "c", "shape"))), lambda x: F.when(x["shape"] != "0", x["c"])).alias("cs"))
    assert {(r.id, r.trials_pos): r.cs for r in cells.collect()} == {(1, 0): [7, None, 8]}


def test_variants_are_routed_to_typed_tables(spark):
    t = nested.flat_tables(records(spark), "id")
    typed = nested.typed_tables(t["trials"], ["id", "trials_pos"], "p")
    assert list(typed) == ["{t,w}", ""] and typed["{t,w}"].collect() == [Row(id=1, trials_pos=0, t=2.0, w=True)]
    assert typed[""].columns == ["id", "trials_pos", "variant", "t", "w"] and typed[""].count() == 0
    # a variant beyond the table's limit keeps its rows
    assert nested.typed_tables(t["trials"], ["id", "trials_pos"], "p", most=0)[""].collect() == [Row(id=1, trials_pos=0, variant="{t,w}", t=2.0, w=True)]
    cat = nested.shape_catalogue(t)
    assert cat.where("tbl = 'record' AND object = 'm'").agg(F.sum("n_rows")).first()[0] == 3


def test_clashing_names_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "s", [(5, 6)])], "id long, shape string, a array<struct<a_pos:int,id:int>>")
    t = nested.flat_tables(df, "id")
    assert t[""].collect() == [Row(id=1, shape_="s", shape="{shape,a:f}")]
    assert t["a"].columns == ["id", "a_pos", "a_pos_", "id_", "shape"]
    assert nested.flat_tables(records(spark).limit(0), "id")["trials_cells"].count() == 0


def test_has_field_matches_whole_names(spark):
    df = spark.createDataFrame([("{tt,w}",), ("{t:f,w}",), ("{a,t}",), ("0",), (None,), ("{p:{t,w},cells:n}",), ("{p:{q:{t}},t:{x}}",), ("{}",)], "s string")
    assert [r[0] for r in df.select(nested.has_field(F.col("s"), "t")).collect()] == [False, True, True, False, False, False, True, False]
