import math
from datetime import datetime

import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from latticeflow.operators.packed import best_parse, candidates, code_book, parse_packed, scan, unpack, well_quoted

SCHEMA = "id long, label string, features string, segmentation string, added_at timestamp, field string, pos int"
T = [datetime(2022, 1, d) for d in range(1, 9)]


def parse(text):
    return best_parse(text, {})[1]


def test_dialects():
    assert parse("[SP1]-mem-[SP3]") == ["[SP1]", "mem", "[SP3]"]
    assert parse("a:1/b:2") == ["a:1", "b:2"]
    assert parse('["[SP1]", "mem", "x"]') == ["[SP1]", "mem", "x"]
    assert parse('-a--"b-c"-') == ["a", "b-c"]
    assert parse("'p46', \"r213\", “s44”") == ["p46", "r213", "s44"]
    assert parse("zu'rik-stü-'doush/slo'") == ["zu'rik", "stü", "doush/slo"]
    assert parse("'zu'rik:25'/b:1") == ["zu'rik:25", "b:1"]
    assert parse("'letutosegu'") == ["letutosegu"]
    assert parse("p46\tr15，s25 | p41;r29") == ["p46", "r15", "s25", "p41", "r29"]
    assert parse("  a - b \n") == ["a", "b"]


def test_nothing_in_it():
    for text in (None, "", "   ", "---", '""', "[]", "-\t-"):
        assert parse(text) == []


def test_dialect_names():
    assert best_parse("a-b-c", {})[0] == "plain -"
    assert best_parse('"a"-"b"', {})[0] == "quoted -"
    assert best_parse("a-b,c;d|e", {})[0] == "plain mixed"


def test_very_long_field():
    text = "-".join(f"v{i}" for i in range(100_000))
    assert len(parse(text)) == 100_000


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.one_of(st.text("abcäñ1:'", min_size=1, max_size=6).map(lambda v: "x" + v + "y"), st.sampled_from(["[SP1]", "[SP3]"])), min_size=1, max_size=8),
    st.sampled_from(["-", "/", "|", ",", ";", "\t", "，", " / ", "--"]),
    st.sampled_from(["", '"', "“", "'"]),
)
def test_round_trip(values, sep, quote):
    close = {"“": "”"}.get(quote, quote)
    if quote == "'":
        values = [v.replace("'", "") for v in values]
    assert parse(sep.join(quote + v + close for v in values)) == values


@settings(max_examples=200, deadline=None)
@given(st.text("ab-/|, \t[]SP1:", max_size=20))
def test_unquoted_fields_against_brute_force(text):
    assert scan(text, True)[0] == regex.findall(r"\[SP[123]\]|[\p{L}\p{N}:]+", text)


def test_unpack_table(spark):
    rows = [
        (1, "a:1/b:2", "p1-r2", None, T[0], "clash", 7),
        (1, "a:1/b:2", "p1-r2", None, T[1], "clash", 8),
        (2, "late", None, "", T[5], None, None),
        (2, "first/x", None, "", T[2], None, None),
        (None, "no", "no", "no", T[0], None, None),
        (3, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, unpack(df, "id", ["label", "features", "segmentation"], "added_at").collect()))
    assert got == [(1, "features", 0, "p1"), (1, "features", 1, "r2"), (1, "label", 0, "a:1"), (1, "label", 1, "b:2"), (2, "label", 0, "first"), (2, "label", 1, "x")]


def test_quoted_value_is_one_value_whatever_the_book():
    cheap = {v: 1.0 for v in ("seventeen", "eighteen", "a", "b")}
    assert best_parse('"seventeen-eighteen"', cheap) == ("quoted single", ["seventeen-eighteen"])
    assert best_parse("a-“seventeen-eighteen”-b", cheap) == ("quoted -", ["a", "seventeen-eighteen", "b"])
    assert best_parse('["a", "b-a"]', cheap)[1] == ["a", "b-a"]
    assert not well_quoted('5"-a-6"') and not well_quoted('"a"-b"') and not well_quoted("it's-a")


def test_delimiters_are_selected(spark):
    towns = ["new york", "old paris", "san jose", "bad ems"]
    assert {n: v for n, v, _ in candidates("new york, old paris", strict=False)} == {"plain mixed": ["new", "york", "old", "paris"], "plain  ": ["new", "york, old", "paris"], "plain ,": ["new york", "old paris"]}
    assert best_parse("new york, old paris", {}) == ("plain mixed", ["new", "york", "old", "paris"])
    rows = [(f"{a}, {b}",) for a in towns for b in towns for _ in range(20)] + [("x_1;y_2|z_3",), ("x_1;y_2",)] * 30
    got = {(tuple(r.v), r.v_dialect) for r in parse_packed(spark.createDataFrame(rows, "v string"), ["v"], strict=False).collect()}
    assert (("new york", "old paris"), "plain ,") in got and len([v for v, d in got if d == "plain ,"]) == 16
    strict = {tuple(r.v) for r in parse_packed(spark.createDataFrame(rows, "v string"), ["v"]).collect()}
    assert ("new", "york", "old", "paris") in strict


def test_long_values_have_a_code(spark):
    long = "x" * 300
    rows = [(f'5"-{long}-6"',), (f"{long}-a",)] * 10
    df = spark.createDataFrame(rows, "v string")
    assert code_book(df, ["v"])["v"].get(long) is not None and code_book(df.where("v like 'x%'"), ["v"]) == {}


def test_empty_table_and_book(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert code_book(df, ["label"]) == {}
    assert unpack(df, "id", ["label"], "added_at").count() == 0
    assert parse_packed(df, ["label"]).columns[-2:] == ["label", "label_dialect"]


def test_description_length_decides_between_all_dialects():
    mixed = {n: (v, bits) for n, v, bits in candidates("a-b,c")}
    assert mixed.keys() == {"plain mixed", "plain -", "plain ,"} and mixed["plain -"][0] == ["a", "b,c"]
    assert math.isfinite(mixed["plain mixed"][1]) and mixed["plain -"][1] == mixed["plain ,"][1] == math.inf
    assert best_parse("a-b,c", {"b,c": 0.001, "a": 0.001}) == ("plain mixed", ["a", "b", "c"])
    quoted = {n: bits for n, _, bits in candidates('"a-b"-"c"')}
    assert quoted["plain -"] == math.inf and math.isfinite(quoted["quoted -"])
    stray = {n: bits for n, _, bits in candidates('5"-a-6"')}
    assert sum(map(math.isfinite, stray.values())) == 2  # here the code book decides
