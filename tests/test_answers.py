import json

from pyspark.sql import functions as F

from deckflow.functions import answers


def parse(spark, raw):
    df = spark.createDataFrame([(raw,)], "raw string")
    p = df.select(answers.parse_answer(F.col("raw")).alias("p")).select(
        F.to_json("p.json").alias("json"), "p.repair", "p.suspect", "p.text"
    )
    row = p.first()
    return (json.loads(row.json) if row.json is not None else None), row


def test_latex_commands_survive(spark):
    raw = r"""
    {"cards": [{"question": "Take \frac{a}{b} with \alpha.",
                "answer": "It is \sigma^2, \(\nu\), \upsilon and \beta."}]}
    """
    value, row = parse(spark, raw)
    card = value["cards"][0]
    assert row.repair == 1
    assert r"\frac" in card["question"] and r"\alpha" in card["question"]
    for command in (r"\sigma", r"\nu", r"\upsilon", r"\beta"):
        assert command in card["answer"]
    assert not set("\f\b\t\r") & set(card["question"] + card["answer"])


def test_genuine_escape_is_kept(spark):
    value, row = parse(spark, '{"a": "line1\\nline2"}')
    assert value == {"a": "line1\nline2"} and row.repair == 0 and not row.suspect


def test_fence_is_removed(spark):
    assert parse(spark, '```json\n{"a": 1, "b": [1, 2, 3]}\n```')[0] == {"a": 1, "b": [1, 2, 3]}


def test_mixed_escapes_take_the_last_repair(spark):
    raw = (
        r'{"question": "Solve $\frac{1}{n}\sum x_i$", '
        r'"answer": "Note $$\hat\sigma^2$$ and matrix row \\\\ next"}'
    )
    value, row = parse(spark, raw)
    assert row.repair == 2
    assert r"\frac{1}{n}\sum x_i" in value["question"]
    assert r"\hat\sigma^2" in value["answer"]


def test_unreadable_answer_has_no_value(spark):
    for raw in ("no answer", '{"a" 1}', ""):
        value, row = parse(spark, raw)
        assert value is None and row.repair is None, raw


def test_cut_off_answer_is_closed(spark):
    for raw, expected in (
        ('{"a": "cut off', {"a": "cut off"}),
        ('{"a": [1, {"b": "x"}, ', {"a": [1, {"b": "x"}]}),
        ('{"a": {"b": [[], {}, "]"', {"a": {"b": [[], {}, "]"]}}),
        ('{"a": 1, "b', {"a": 1, "b": None}),
        ('{"a": 1, "b":', {"a": 1, "b": None}),
        ('{"a": "quote \\" in', {"a": 'quote " in'}),
        ('{"a": "slash \\', {"a": "slash \\"}),
        ('```json\n{"a": ["' + "x" * 50_000, {"a": ["x" * 50_000]}),
    ):
        value, row = parse(spark, raw)
        assert value == expected and row.repair == 3


def test_valid_text_with_lost_command_is_suspect(spark):
    value, row = parse(spark, r'{"q": "\frac"}')
    assert value == {"q": "\x0crac"} and row.suspect


def test_defaults_of_missing_fields(spark):
    df = spark.createDataFrame([('{"x": 1}',)], "raw string").select(
        answers.parse_answer(F.col("raw")).alias("p")
    )
    row = df.select(
        answers.cards_of(F.col("p.json")),
        answers.themes_of(F.col("p.json")),
        answers.resolved_of(F.col("p.text")),
        answers.new_themes_of(F.col("p.json")),
        answers.redundant_of(F.col("p.json")),
    ).first()
    assert tuple(row) == ([], [], {}, [], False)


def test_order_of_resolved_themes_is_kept(spark):
    raw = '{"resolved": {"b": ["x"], "a": ["y", "z"], "c": []}}'
    df = spark.createDataFrame([(raw,)], "raw string").select(
        answers.resolved_of(answers.parse_answer(F.col("raw"))["text"]).alias("r")
    )
    listed = df.select(F.map_entries("r").alias("e")).first().e
    assert [(e.key, e.value) for e in listed] == [("b", ["x"]), ("a", ["y", "z"]), ("c", [])]


def test_a_deeply_nested_answer_that_is_cut_off_is_closed(spark):
    rows = [(n, '{"k": ' + '[{"x": ' * n + '"cut o') for n in (1, 16, 17, 60)]
    df = spark.createDataFrame(rows, "n int, raw string").select("n", answers.parse_answer(F.col("raw")).alias("p"))
    for r in df.select("n", "p.repair", "p.text").collect():
        assert r.repair == 3 and r.text == rows[[x[0] for x in rows].index(r.n)][1] + '"' + "}]" * r.n + "}"
