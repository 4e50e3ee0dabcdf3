import hashlib
import re
import uuid

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestone.functions import identity
from lodestone.functions import text as T
from lodestone.functions.html import html_text

TRICKY = ["", " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0 　", " a  b\x85", "a\r\nb\rc\n", "Ünï-cödé foo--bar _x 12", "[1][2] [1] [1, 2] [x] [99999999999]"]


def one(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["r"] for r in rows.select("i", column.alias("r")).orderBy("i").collect()]


def test_strip_and_collapse_are_pythons(spark):
    assert one(spark, TRICKY, T.strip("t")) == [t.strip() for t in TRICKY]
    assert one(spark, TRICKY, T.collapse("t")) == [" ".join(t.lower().split()) for t in TRICKY]


def test_normalize(spark):
    want = [t.replace("\r\n", "\n").replace("\r", "\n").strip() for t in TRICKY]
    assert one(spark, TRICKY, T.normalize("t")) == want


def test_tokens(spark):
    assert one(spark, TRICKY, T.tokens("t")) == [re.findall(r"\b[\w\-]+\b", t.lower()) for t in TRICKY]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aB1 -_.\n\té[]", max_size=30), min_size=20, max_size=40))
def test_tokens_and_strip_on_random_texts(spark, texts):
    assert one(spark, texts, T.tokens("t")) == [re.findall(r"\b[\w\-]+\b", t.lower()) for t in texts]
    assert one(spark, texts, T.strip("t")) == [t.strip() for t in texts]


def test_references_in_order_once(spark):
    assert one(spark, ["b [2] a [1][2] [3]", "[1, 2]", None], T.references("t")) == [[2, 1, 3], [], None]


def test_identities(spark):
    row = spark.createDataFrame([("dir/a.md", 3, "tëxt")], "s string, i int, t string")
    got = row.select(identity.chunk_id("s", "i", "t").alias("c"), identity.point_id("t", "p:").alias("p")).first()
    assert got["c"] == hashlib.sha256("dir/a.md:3:tëxt".encode()).hexdigest()
    assert got["p"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "p:tëxt"))


def test_point_ids_of_many(spark):
    names = [f"n{i}" for i in range(64)]
    assert one(spark, names, identity.point_id("t")) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_html_text():
    page = "<html><style>x{}</style><body><h1>A &amp; B</h1><!-- c --><p>one<b> two </b>three<script>no()</script><p>four</body>"
    assert html_text(page) == "A & B\none\ntwo\nthree\nfour"
    assert html_text(None) == ""


def test_paths_and_answers(spark):
    assert one(spark, [".\\Data\\A.MD ", "./x/./y"], T.path("t")) == ["data/a.md", "x/./y"]
    assert one(spark, ["The `Cache` [1] is\n ON [12]."], T.answer_text("t")) == ["the cache is on ."]
    assert one(spark, ["One. Two!  Three"], T.sentences("t")) == [["One.", "Two!", "Three"]]


def test_html_query_reads_entities_as_its_sql_does(spark, tmp_path):
    from lodestone.plans.registry import QUERIES

    pages = [(1, "<title>a &amp;&amp;&amp</title><p>x &copy; y &#65; &lt3 & z &nosuch b</p>")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert QUERIES["html_text"](spark, str(tmp_path)).first()["text"] == "a &&&amp\nx \u00a9 y A &lt3 & z &nosuch b"
