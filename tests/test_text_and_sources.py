import pytest
from pyspark.sql import functions as F

from citeflow.functions.text import WHITESPACE, strip, tokens
from citeflow.settings import Settings
from citeflow.sources import corpus, logs, statements, transcript
from tests.conftest import plan_of


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t"))).first()[0]


@pytest.mark.parametrize("text", ["", " a b ", "\t\n x \r", " y　", "\x1cz\x1f", "​kept​", "a\n"])
def test_strip_is_python_strip(spark, text):
    assert one(spark, text, strip) == text.strip()


def test_whitespace_is_complete():
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_tokens(spark):
    assert one(spark, "It's ÉTÉ-42, no?", tokens) == ["it", "s", "été", "42", "no"]


def test_settings_ranges():
    assert Settings().num_chunks == 10 and Settings().model_name == "extractive"
    assert Settings(provider="openai").model_name == "gpt-4.1"
    for bad in ({"num_chunks": 0}, {"num_messages": 21}, {"provider": "nobody"}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_catalog_and_select(spark):
    df = spark.createDataFrame([(1, "a", "b")], "chunk_id long, chunk string, extra string")
    corpus.register_corpus(df, "cat_one", "chunk")
    corpus.register_corpus(df.withMetadata("extra", {"search_column": True}), "cat_two", "chunk")
    df.createOrReplaceTempView("cat_plain")
    catalog = corpus.corpus_catalog(spark)
    found = {r["name"]: r["search_column"] for r in catalog.collect()}
    # only the first marked column counts, and unmarked tables are no corpora
    assert found["cat_one"] == "chunk" and found["cat_two"] == "chunk" and "cat_plain" not in found
    table, column = corpus.corpus_select(spark, catalog, "cat_one")
    assert table.collect() == df.collect() and column == "chunk"
    with pytest.raises(LookupError):
        corpus.corpus_select(spark, catalog, "nowhere")
    assert corpus.questions_enabled(catalog)
    assert not corpus.questions_enabled(catalog.filter("false"))


def test_content_fallback(spark):
    def content(schema, row, search="body"):
        df = spark.createDataFrame([row], schema)
        return corpus.content_fallback(df, search).collect()[0][-1]

    assert content("CONTENT string", ("x",)) == "x"
    assert content("body string, chunk string", ("b", "c")) == "b"
    # a present null does not fall through
    assert content("chunk string, content string", (None, "c")) == (
        "Content not found - available keys: ['chunk', 'content']"
    )
    assert content("id long", (1,)) == "Content not found - available keys: ['id']"
    # names that differ by case only are told apart
    assert content("CHUNK string, chunk string", ("up", "low")) == "low"
    assert content("CHUNK string, Content string", ("up", "c")) == "up"


def test_log_tail(spark):
    df = spark.createDataFrame([(1, "a\n\n  \nb\n\t\nc\n"), (2, "")], "id long, text string")
    rows = [tuple(r) for r in logs.log_tail(df, "text", 3).collect()]
    # only spaces are trimmed, so the tab line stays
    assert rows == [(1, 6, "c"), (1, 5, "\t"), (1, 4, "b")]
    lines = logs.log_lines(df, "text")
    assert {tuple(r) for r in lines.collect()} == {(1, 1, "a"), *rows}
    assert [r["index"] for r in logs.last_lines(lines, ["index"], 2).collect()] == [6, 5]
    by = logs.last_lines(lines, ["index"], 2, by=["id"])
    assert {r["index"] for r in by.collect()} == {6, 5}
    assert "WindowGroupLimit" in plan_of(by)
    assert "TakeOrderedAndProject" in plan_of(logs.last_lines(lines, ["index"], 2))
    assert "Exchange" not in plan_of(logs.log_tail(df, "text"))


def test_pages(spark):
    html = (
        "<html><head><title> A &amp;lt; B </title><style>p{}</style></head><body><nav>menu</nav>"
        "<script>var t='</p>';</script><!-- no --><p>One&nbsp;two &lt;b&gt;</p>\n<p>three</p></body></html>"
    )
    df = spark.createDataFrame([(1, "http://u", html)], "page_id long, url string, html string")
    row = corpus.corpus_from_pages(df).first()
    assert row["document_title"] == "A &lt; B"
    assert row["chunk"] == "One two <b> three"
    assert row["source_url"] == "http://u"


def test_chunk_windows(spark):
    words = [f"w{i}" for i in range(23)]
    df = spark.createDataFrame([(1, "  ".join(words)), (2, " \n "), (3, "solo")], "id long, text string")
    rows = corpus.chunk_documents(df, "text", size=10, overlap=3)
    made = {(r["id"], r["chunk_no"]): r["chunk"].split() for r in rows.collect()}
    assert made == {
        (1, 1): words[0:10],
        (1, 2): words[7:17],
        (1, 3): words[14:23],
        (3, 1): ["solo"],
    }
    assert "Exchange" not in plan_of(rows)
    # as many words as the window: one window
    exact = spark.createDataFrame([(1, "a b c d")], "id long, text string")
    assert corpus.chunk_documents(exact, "text", 4, 1).count() == 1
    with pytest.raises(ValueError):
        corpus.chunk_documents(df, "text", 3, 3)


def test_statements(spark):
    df = spark.createDataFrame([("ab_1", 1), ("cd", 2)], "name string, n int")
    piped = statements.piped_query(df, "it's")
    assert piped.columns == ["description", "name", "n"] and piped.first()[0] == "it's"
    assert statements.like_filter_concat(df, "name", "ab", "open ", "c").collect()[0][0] == "open ab_1"
    statements.remember_result(df.filter("n = 2"), "kept_rows")
    assert statements.result_scan(spark, "kept_rows").collect()[0]["name"] == "cd"
    bound = statements.bound_query(spark, "SELECT ? AS v FROM {t} WHERE n = ?", ["'; DROP", 1], t=df)
    assert [r["v"] for r in bound.collect()] == ["'; DROP"]


def test_transcript_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 0, "q1", "a1"), (2, 0, "q2", ""), (3, 0, "q3", None)],
        "conv_id long, turn long, question string, response string",
    )
    path = str(tmp_path / "t")
    for _ in range(2):
        transcript.transcript_append(transcript.transcript_rows(df, True), path, 0)
    transcript.transcript_append(transcript.transcript_rows(df, False), path, 1)
    rows = transcript.read_transcript(spark, path)
    bot = rows.filter("batch_id = 0").orderBy("part").select("conv_id", "role", "content").collect()
    assert [tuple(r) for r in bot] == [(1, "user", "q1"), (1, "assistant", "a1")]
    assert rows.filter("batch_id = 1").count() == 6
