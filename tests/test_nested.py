import json

from wavelattice.operators.nested import areas_table, flatten_records, further_table, observations_table, revisions_table, series_table

RECORDS = [
    (1, json.dumps({"series_id": "A", "data": [["2001", 1.5], [], None, {"period": "2002", "value": "x", "revisions": [None, {"on": "2003-01-01", "value": 2}]}, ["", 3], [2004, None]], "geography": ["X", None, {"code": "Y", "share": 0.5}, ""],
        "children": [None, {}, {"series_id": "B", "geography": {"code": "Z"}, "children": [{"name": "no id", "data": '[["1999", 7]]'}]}]})),
    (2, json.dumps({"request": {"command": "series"}, "series": [{"series_id": "C", "data": [["1", 1]], "geography": "W"}]})),
    (3, "{broken"), (4, None), (5, ""), (6, "null"), (7, "[1, 2]"), (8, '{"a": NaN}'), (9, '{"x": 1}'),
    (1, json.dumps({"series_id": "again"})),
]


def test_tables(spark):
    df = spark.createDataFrame([(*r, 5, "p") for r in RECORDS], "record_id long, record string, pos int, parent string")
    n = flatten_records(df, "record_id", "record").cache()
    s = {(r.record_id, r.series_id): r for r in series_table(n).collect()}
    assert set(s) == {(1, "A"), (1, "B"), (1, ""), (2, "C"), (1, "again")}
    assert s[1, "B"].parent == s[1, "A"].dewey and s[1, "B"].pos == 2 and s[1, ""].parent_series_id == "B"
    o = {(r.record_id, r.series_id, r.pos): r for r in observations_table(n).collect()}
    assert set(o) == {(1, "A", 0), (1, "A", 3), (1, "A", 5), (1, "", 0), (2, "C", 0)}
    assert o[1, "A", 0].value == 1.5 and o[1, "A", 3].value is None and o[1, "A", 5].period == "2004"
    (rev,) = revisions_table(n).collect()
    assert (rev.revised_on, rev.pos, rev.parent) == ("2003-01-01", 3, o[1, "A", 3].dewey)
    assert {(r.record_id, r.series_id, r.pos, r.code) for r in areas_table(n).collect()} == {(1, "A", 0, "X"), (1, "A", 2, "Y"), (1, "B", 0, "Z"), (2, "C", 0, "W")}
    n.unpersist()


def test_deep_and_long(spark):
    deep = {"series_id": "end"}
    for k in range(300):
        deep = {"series_id": f"s{k}", "children": [deep]}
    long = {"series_id": "L", "data": [[str(i), i] for i in range(20_000)]}
    df = spark.createDataFrame([(1, json.dumps(deep)), (2, json.dumps(long))], "record_id long, record string")
    n = flatten_records(df, "record_id", "record")
    assert series_table(n).count() == 302 and observations_table(n).count() == 20_000
    assert flatten_records(df.limit(0), "record_id", "record").count() == 0


def test_nothing_is_lost(spark):
    record = {
        "series_id": "A", "name": "n", "updated": "2024", "description": {"en": "text"}, "notes": [{"by": "x", "tags": [["a", 1], ["b", 2]]}, 7],
        "data": [["2001", 1, "p", {"q": 2}], {"period": "2002", "value": 3, "unit": "MW", "revisions": [{"on": "d", "value": 4, "why": "typo"}]}, {"value": 9}, 5],
        "geography": {"code": "Z", "share": "most", "label": "Zed"}, "children": [{"series_id": "B", "extra": True}],
    }
    df = spark.createDataFrame([(1, json.dumps({"request": {"id": 3}, "series": [record]}))], "record_id long, record string")
    rows = {tuple(r.dewey): r for r in flatten_records(df, "record_id", "record").collect()}
    for label, r in rows.items():  # every parent is there, by truncation
        assert r.parent == (list(label[:-2]) if len(label) > 2 else None) and (len(label) < 3 or label[:-2] in rows)
    extra = {r.path + str(r.pos): json.loads(r.extra) for r in rows.values() if r.extra}
    assert extra["$0"] == {"request": {"id": 3}}
    assert extra["$.series[]0"] == {"updated": "2024", "description": {"en": "text"}}
    assert extra["$.series[].notes[]0"] == {"by": "x"} and extra["$.series[].notes[]1"] == 7
    assert extra["$.series[].notes[].tags[]0"] == ["a", 1] and extra["$.series[].notes[].tags[]1"] == ["b", 2]
    assert extra["$.series[].data[]0"] == {"2": "p", "3": {"q": 2}} and extra["$.series[].data[]1"] == {"unit": "MW"}
    assert extra["$.series[].data[]2"] == {"value": 9} and extra["$.series[].data[]3"] == 5
    assert extra["$.series[].data[].revisions[]1"] == {"why": "typo"}
    assert extra["$.series[].geography[]0"] == {"share": "most", "label": "Zed"} and extra["$.series[].children[]0"] == {"extra": True}
    assert further_table(flatten_records(df, "record_id", "record")).count() == 7


def test_numbers_are_strict(spark):
    values = ["1_000", "nan", "inf", "1e3", " 2.5 ", "-.5", True, "0x10", 1e400, None]
    df = spark.createDataFrame([(1, json.dumps({"series_id": "A", "data": [[str(i), v] for i, v in enumerate(values) if v != 1e400]}))], "record_id long, record string")
    got = {r.period: r.value for r in observations_table(flatten_records(df, "record_id", "record")).collect()}
    assert got == {"0": None, "1": None, "2": None, "3": 1000.0, "4": 2.5, "5": -0.5, "6": None, "7": None, "9": None}
