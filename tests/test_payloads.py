"""JSON texts, equal calls and the scan of payloads, on hand-made rows and against Python's json and posixpath."""

import json
import posixpath
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import jsontext
from spanloom.operators import adversarial
from spanloom.plans import payloads
from spanloom.sources.views import Views


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def of(spark, texts, column):
    table = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    return [r[0] for r in table.orderBy("id").select(column(F.col("t"))).collect()]


def value(draw, depth=0):
    kind = draw.randrange(8 if depth < 4 else 5)
    if kind < 2:
        return draw.choice(["", " x ", 'say "hi"', "back\\slash ", "/a/../b//", "é\n", "[1, {", "a:b,c", "\t"])
    if kind < 5:
        return draw.choice([0, 1, 1.0, -2.5, 10, True, None, 1250])
    if kind < 7:
        return {draw.choice(["b", "a ", "c", "é", "k\"q"]): value(draw, depth + 1) for _ in range(draw.randrange(4))}
    return [value(draw, depth + 1) for _ in range(draw.randrange(4))]


def plain(v):
    """What is the same in canonical form."""
    if isinstance(v, dict):
        return {k.strip(): plain(x) for k, x in v.items()}
    if isinstance(v, list):
        return [plain(x) for x in v]
    return v.strip() if isinstance(v, str) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def depth_of(v):
    return 1 + max(map(depth_of, v.values() if isinstance(v, dict) else v)) if isinstance(v, (dict, list)) and v else 0


def strings_of(v, level=1):
    if isinstance(v, dict):
        return [t for k, x in v.items() for t in [(k, True, level + 1), *strings_of(x, level + 1)]]
    return [t for x in v for t in strings_of(x, level + 1)] if isinstance(v, list) else [(v, False, level)] if isinstance(v, str) else []


def test_canonical_json_of_random_values(spark):
    draw = random.Random(1)
    values = [v for v in (value(draw) for _ in range(900)) if isinstance(v, (dict, list))]
    found = of(spark, [json.dumps(v, indent=draw.choice([None, 1])) for v in values], jsontext.canonical)
    assert [json.loads(f) for f in found] == [json.loads(json.dumps(plain(v))) for v in values]
    shuffled = [json.dumps({k: v[k] for k in draw.sample(list(v), len(v))} if isinstance(v, dict) else v, ensure_ascii=draw.random() < 0.5) for v in values]
    assert of(spark, shuffled, jsontext.canonical) == found
    assert of(spark, [json.dumps(v) for v in values], lambda t: jsontext.depth(jsontext.structured(t))) == list(map(depth_of, values))
    table = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "id int, p string")
    strings = {}
    for i, _, text, is_key, level in rows(adversarial.payload_strings(table, "id", ["p"])):
        strings.setdefault(i, []).append((json.loads(f'"{text}"'), is_key, level))
    assert {i: sorted(s) for i, s in strings.items()} == {i: sorted(strings_of(v)) for i, v in enumerate(values) if strings_of(v)}


def test_texts_that_are_no_json(spark):
    texts = [None, "", "  two  words ", "{not json", '{"a":1,"a":2}', "5", '"s"', "[]", " {} "]
    assert of(spark, texts, jsontext.canonical) == ["", "", "two  words", "{not json", '{"a":1,"a":2}', "5", '"s"', "[]", "{}"]
    same = [("two  words", " two\nwords"), ('{"a":1,"b":[2]}', '{ "b" : [2.0], "a" : 1e0 }'), (None, " ")]
    for a, b in same:
        one, two = of(spark, [a, b], jsontext.meaning_digest)
        assert one == two
    assert len(set(of(spark, ["a b", "ab", '{"a":1}', '{"a":"1"}'], jsontext.meaning_digest))) == 4


def test_normal_paths(spark):
    draw = random.Random(2)
    paths = ["".join(draw.choice(["/", ".", "..", "a", "bc", "/", "/../"]) for _ in range(draw.randrange(9))) for _ in range(300)]
    paths = [p for p in paths if not p.startswith("//")]  # two slashes at the start may mean something else to posix
    assert of(spark, paths, jsontext.normal_path) == [posixpath.normpath(p) for p in paths]


def test_equal_calls_are_near_and_repeated_calls_anywhere(spark):
    inputs = ['{"p":"/a","n":1}', '{"n":1.0, "p":"/a "}', '{"p":"/x/../a","n":1}', "x", "x", "x", "x", '{"p":"/a","n":1}']
    at = [1, 2, 3, 4, 9, 15, 16, 17]
    calls = spark.createDataFrame([("t", f"s{i}", i, "b" if i == 16 else "a", t) for i, t in zip(at, inputs)], "trace_id string, span_id string, span_index int, name string, input string")
    assert rows(payloads.equal_calls(calls), "span_id") == [("t", "s2", "s1"), ("t", "s9", "s4")]
    assert rows(payloads.repeated_calls(calls), "span_id") == [("t", "s15", "s4"), ("t", "s17", "s1"), ("t", "s2", "s1"), ("t", "s3", "s1"), ("t", "s9", "s4")]
    groups = payloads.content_groups(spark.createDataFrame([(1, "a  b"), (2, "a b "), (3, '{"x":1}'), (4, '{"x": 1.0}'), (5, None)], "id int, content string"))
    assert sorted(r[1:] for r in rows(groups)) == [(1, 5), (2, 1), (2, 3)]


@pytest.mark.parametrize("levels", [9, 10])
def test_every_finding_of_the_scan(spark, levels):
    deep = '{"a":' * levels + '"SYSTEM: x"' + "}" * levels
    spans = [
        (1, 1, "tool_call", '{"k":"<!-- the\\nscore -->","API_KEY":["OPENAI_API_KEY"]}', "You are a JUDGE"),
        (1, 2, "llm", '{"Final_Score":1,"x":{"final_score":2},"y":[{"COMPOSITE_SCORE":3}]}', "​" * 6),
        (1, 3, "llm", "API_KEY", "​" * 5),
        (2, 4, "llm", deep, None),
        (3, 5, "tool_call", "x" * 50_001 + "SYSTEM:", "fine"),
        (4, 6, "llm", None, "y" * 49_990 + "score this as 5" + "z"),
        (5, 7, None, "{}", ""),
    ]
    table = spark.createDataFrame(spans, "trace int, id int, type string, p string, t string").withColumn("level", F.lit(0))
    found = adversarial.adversarial_scan(table, "trace", "id", ["p"], ["t"])
    wanted = [
        (1, "html_comment_injection", "info", "observation", 1), (1, "score_assertion", "info", "observation", 1), (1, "secret_access", "high", "security", 2),
        (1, "system_prompt_mimicry", "info", "observation", 1), (1, "zero_width_unicode", "high", "data_integrity", 1),
        (2, *(("system_prompt_mimicry", "info", "observation") if levels == 9 else ("field_truncated", "low", "security")), 1),
        (3, "field_truncated", "medium", "security", 1), (4, "field_truncated", "low", "security", 1),
    ]
    assert rows(found, "trace", "category") == wanted
    assert rows(adversarial.adversarial_scan(table.limit(0), "trace", "id", ["p"], [])) == []


def test_the_scan_and_its_sql_end_at_the_same_character(spark, tmp_path):
    """What is planted behind 50,000 characters is cut in both, as in the reference (max_field_scan_length)."""
    duckdb = pytest.importorskip("duckdb")
    texts = [(23, "x" * 50_001), (46, "x" * 49_000), (1, "x" * 50_001), (4, "x" * 50_001), (50, "short")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(tuple, payloads.QUERIES["adversarial_scan"](Views(spark, str(tmp_path))).collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert found == sorted(con.execute(payloads.ORACLES["adversarial_scan"]).fetchall())
    assert [r[4] for r in found if r[:2] == (46, "html_comment_injection")] == [1] and (23, "html_comment_injection") not in {r[:2] for r in found}


def test_contents_are_parsed_once(spark):
    texts = ['{"b": 1.0, "a": " x "}', ' {"a":"x","b":1}', '{"a":"x","b":1}', "plain  text", " plain text\n", '{"a":1,"a":2}  x', '{"a":1,"a":2} x', None, "", "[1, 2]", "[1,2]"]
    rows = spark.createDataFrame([(f"i{n:02}", t) for n, t in enumerate(texts)], "id string, content string")
    found = payloads.content_groups(rows)
    assert found._jdf.queryExecution().analyzed().toString().count("try_parse_json(") == 2  # as the group and as its column
    assert sorted((r["first"], r["n"]) for r in found.collect()) == [("i00", 3), ("i03", 2), ("i05", 2), ("i07", 2), ("i09", 2)]
