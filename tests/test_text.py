"""Tables of inputs and expected values of the text functions."""

import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.functions.html import content_of
from lexweave.operators import chunking, symbols


def column(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_scores(spark):
    assert column(spark, X.parse_score, ["0.85", ".42", "Score: 0.85", "1.5", "-0.5", "nope", "", None]) == [0.85, 0.42, 0.85, 1.0, 0.5, 0.0, 0.0, 0.0]


def test_query_shape(spark):
    yes = ["MoveLinear", "Controller.Connect", "MoveLinear()", "std::vector", "move_linear"]
    no = ["how do I configure homing", "introduction to the library"]
    assert column(spark, X.query_shape, yes + no) == [True] * 5 + [False] * 2


DROP = ["IMPORTANT", "HARDWARE", "RAM", "CPU", "BD", "TCP", "UTF", "GHz", "RPM", "dB", "NOTE", "OK"]
KEEP = ["PIDController", "XMLParser", "IOError", "HTTPRequest", "MoveLinear", "EasyTune"]


def test_rejections(spark):
    chunks = spark.createDataFrame([("l", "1", str(i), w) for i, w in enumerate(DROP + KEEP)], "library_id string, version string, id string, content string")
    got = {r.name: r.reason for r in symbols.extract(chunks).collect()}
    assert all(got[w] for w in DROP)
    assert not any(got[w] for w in KEEP)


def test_tokens():
    got = symbols.candidates("class Foo uses Axis.Move(x), List<int> and std::vector; retry-count. Axis.Move(y)")
    by = {t[0]: t for t in got}
    assert by["Foo"][5] == "class"
    assert by["Axis.Move"] == ("Axis.Move", "Move", "Axis", True, False, None)
    assert by["List"][4] and by["std::vector"][2] == "std" and "retry-count" in by
    assert sum(t[0] == "Axis.Move" for t in got) == 1
    assert symbols.candidates(None) == []


def test_declared_before_much_space():
    assert symbols.candidates("class" + " " * 5000 + "Foo")[1][5] == "class"


def test_sample_window():
    assert symbols.sample_window("a b", "zz") is None
    text = "word " * 100 + "Needle" + " word" * 100
    got = symbols.sample_window(text, "Needle")
    assert "Needle" in got and len(got) <= 200


def test_split():
    text = "a" * 1300 + " Set AxisFault.Disabled to acknowledge the latch and continue. " + "a" * 1300
    pieces = chunking.split_to_limit(text)
    assert len(pieces) >= 2 and all(len(p) <= 2400 for p in pieces)
    assert not any(p.endswith("AxisFault.") or p.startswith("Disabled") for p in pieces)
    assert "".join("".join(pieces).split()) == "".join(text.split())
    assert chunking.split_to_limit("") == []


@pytest.mark.parametrize(
    ("category", "text", "paths"),
    [
        ("HowTo", "intro\n# One\nbody\n## Empty\n\n### Two\nmore", ["T", "T > One", "T > Two"]),
        ("HowTo", "plain", ["T"]),
        ("ChangeLog", "before\n## v1.2\na\n## Version 2\nb", ["T > ## v1", "T > ## Version 2"]),
        ("ChangeLog", "# Notes\nx", ["T > Notes"]),
        ("Sample", "a\n\nb", ["T"]),
        ("Overview", "", ["T"]),
    ],
)
def test_sections(category, text, paths):
    assert [p for _, p, _ in chunking.chunk_page("l", "1", "u", "T", category, text)] == paths


def test_paragraph_packs():
    text = "\n\n".join("p" * 1000 for _ in range(8))
    parts = chunking.by_paragraphs("T", text)
    assert len(parts) > 1 and all(len(p) // 4 <= 801 for _, p in parts)


def test_main_content():
    assert content_of("<body><nav>x</nav><main> a <b>b</b></main></body>") == "a b"
    assert content_of("<body><div class='content wide'>c</div><p>d</p></body>") == "c"
    assert content_of("<body>e</body>") == "e"
    assert content_of(None) == ""


def test_fence_tables(spark):
    out = column(spark, X.strip_fences, ["a ```x``` b", "<pre>z</pre>q"])
    assert "x" not in out[0] and "z" not in out[1]
