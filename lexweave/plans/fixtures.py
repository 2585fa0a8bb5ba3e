"""Small tables given in full, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    if isinstance(x, (int, float)):
        return repr(x)
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]"
    return "'" + str(x).replace("'", "''") + "'"


class Given:
    """Rows with a schema, as a DataFrame or as an SQL table expression."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        self.names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        kinds = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]", "timestamp": "TIMESTAMP"}
        types = [kinds[c.strip().split(" ")[1]] for c in self.schema.split(",")]
        body = ", ".join("(" + ", ".join(literal(x) for x in r) + ")" for r in self.rows)
        return "(SELECT " + ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in zip(self.names, types, strict=True)) + f" FROM (VALUES {body}) AS g({', '.join(self.names)}))"


QUERIES = Given("id int, q string", list(enumerate(["MoveLinear", "Controller.Connect", "MoveLinear()", "std::vector", "move_linear", "how do I configure homing", "introduction to the library", "the on of", "x"])))
SCORES = Given("id int, reply string", list(enumerate(["0.85", ".42", "Score: 0.85", "1.5", "-0.5", "nope", "", "7"])))
NAMES = Given("id int, name string", list(enumerate(["IMPORTANT", "HARDWARE", "RAM", "CPU", "BD", "TCP", "UTF", "GHz", "RPM", "dB", "NOTE", "OK", "PIDController", "XMLParser", "IOError", "HTTPRequest", "MoveLinear", "EasyTune", "snake_case", "a.b", "std::vector", "p->q", "values", "x", "MHZ", "rpm", "Kb", "Methods", "mm", "K9"])))
PATHS = Given("id int, path string", list(enumerate(["README.md", "src/readme.txt", "CHANGELOG.md", "release_notes.md", "a/samples/x.cs", "docs/intro.html", "b/doc/x.txt", "guide.rst", "src/main.py", "history.txt", "pkg/demo/run.js"])))
URLS = Given("id int, url string", list(enumerate(["https://Docs.Example.com/guide/intro.html", "https://docs.example.com/guide/", "https://docs.example.com:8080/guide/api.aspx?x=1#top", "https://docs.example.com/other/a.pdf", "http://blog.example.com/blog/post", "https://docs.example.com/", "https://docs.example.com/guide/search?q=1", "https://github.com/owner/repo.git", "https://www.github.com/o/r/tree/main", "https://example.org/x.zip?d=1", "https://docs.example.com/guide/deep/page.htm", "https://docs.example.com/api"])))
CRAWL = Given("id int, scope string, in_depth int, same_depth int, off_depth int", [(0, "in", 0, 0, 0), (1, "in", 10, 0, 0), (2, "in", 9, 5, 5), (3, "same", 3, 1, 0), (4, "same", 3, 2, 0), (5, "off", 0, 0, 0), (6, "off", 0, 0, 1)])
FETCHES = Given("host string, seq int, url string, status int, in_scope boolean", [("a.com", 0, "https://a.com/x/1", 200, True), ("b.com", 1, "https://b.com/private/a", 403, False), ("b.com", 2, "https://b.com/private/b", 200, False), ("b.com", 3, "https://b.com/open/b", 200, False), ("c.com", 4, "https://c.com/x", 429, False), ("a.com", 5, "https://a.com/y", 403, True), ("a.com", 6, "https://a.com/y/2", 503, True), ("b.com", 0, "https://b.com/private/early", 200, False)])
DEPENDENCIES = Given("package_id string, version string, ecosystem_id string", [("Serilog", "2.0", "nuget"), ("serilog", "3.0", "nuget"), ("System.Text.Json", "8.0", "nuget"), ("src1", "2.0", "nuget"), ("SRC2", "9.9", "nuget"), ("react", "^18.2.0", "npm"), ("eslint-plugin-x", "~1.0", "npm"), ("@types/node", "20", "npm"), ("requests", "2.31", "pip"), ("pytest-mock", "3", "pip"), ("src3", "1.0", "pip"), ("requests", "2.31", "pip")])
REGISTRY = Given(
    "package_id string, ecosystem_id string, project_url string, repository_url string, documentation_url string",
    [("Serilog", "nuget", "https://serilog.net", "https://github.com/serilog/serilog", None), ("doc", "nuget", None, None, "https://doc.dev/docs"), ("gh", "nuget", "https://github.com/a/gh", None, None), ("react", "npm", "https://react.dev", "git+https://github.com/facebook/react.git", None), ("left", "npm", "https://github.com/x/left", "git://github.com/x/left.git", None), ("requests", "pip", "https://github.com/psf/requests", None, "https://requests.readthedocs.io"), ("plain", "pip", "https://plain.org", None, None), ("none", "pip", None, None, None)],
)
REACHABLE = Given("url string", [("https://serilog.net",), ("https://none.readthedocs.io",), ("https://docs.none.com",)])
REPLIES = Given("id int, reply string", list(enumerate(['{"category": "HowTo", "confidence": 0.9}', '```json\n{"category": "apireference", "confidence": 0.4}\n```', "It is a Sample page", "no idea", '{"category": "Wrong"}', '{"category": "Code"}'])))
PROFILES = Given("id int, body string", list(enumerate(['{"languages": ["C#"], "likelySymbols": ["Axis"], "casing": {"types": "PascalCase"}, "confidence": 1.7}', '{"confidence": -1}', "{}"])))
RETRIES = Given("id int, value string", list(enumerate(["120", "0", "-5", "Wed, 21 Oct 2026 07:28:00 GMT", "Wed, 21 Oct 2015 07:28:00 GMT", "soon", ""])))
STATES = Given("id int, running boolean, suspect boolean, profile boolean, chunks long, stale boolean, force boolean", [(0, True, True, True, 5, False, False), (1, False, True, True, 5, False, False), (2, False, False, False, 5, False, False), (3, False, False, True, 0, False, False), (4, False, False, True, 5, True, False), (5, False, False, True, 5, False, True), (6, False, False, True, 5, False, False)])
MARKDOWN = Given("id int, content string", [(0, "Intro `x`\n```cs\nvar a = Axis.Move(1);\nstd::vector<int> v;\n```\nMore Axis.Move text. MoveLinear(x) and class Foo"), (1, "<pre class=\"c\"> <code>foo->bar baz_q</code></pre> tail"), (2, "plain text"), (3, "")])
