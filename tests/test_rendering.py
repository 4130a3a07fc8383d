import random

import pytest
from pyspark.sql import functions as F

from checks import inputs as I
from citeflow.functions import markup
from citeflow.operators import rendering
from tests.conftest import plan_of


def value(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t"))).first()[0]


def blocks(spark, text):
    df = spark.createDataFrame([(1, text)], "response_id long, response string")
    return [(b.type, b.text) for b in rendering.with_blocks(df).first()["blocks"]]


def texts(spark, text):
    return [t for _, t in blocks(spark, text)]


def test_split_drops_what_follows_a_second_heading(spark):
    text = " b Sources: s Sources: late"
    assert value(spark, text, markup.body_part) == " b "
    assert value(spark, text, markup.sources_part) == " s "
    assert value(spark, "b", markup.sources_part) == ""


@pytest.mark.parametrize(
    "text, want",
    [
        ("a\n\n- x\n\n* y\nb", "a\n\n- x\n* y\n\nb"),
        ("- x", "\n- x"),
        ("- x\n-y\n* z", "\n- x\n\n-y\n\n* z"),
        ("a  \n b", "a\nb"),
        ("", ""),
        ("a Sources:\n s ", "a\n\n**Sources:**\ns"),
        ("a Sources:  ", "a"),
    ],
)
def test_list_spacing(spark, text, want):
    made = value(spark, text, lambda c: markup.list_spacing(markup.body_part(c), markup.sources_part(c)))
    assert made == want


def test_superscript_turns_every_bracket(spark):
    assert value(spark, "a [^1] [x] ", markup.citation_superscript) == "a <sup>1</sup> [x</sup> "
    assert value(spark, "a [^1] Sources: [^1] t", markup.citation_superscript) == "a <sup>1</sup> \nSources: [^1] t"
    assert value(spark, "a Sources:", markup.citation_superscript) == "a "


def entries(spark, text, **options):
    got = value(spark, text, lambda c: markup.source_lines(c, **options))
    return [(e.num, e.title, e.url) for e in got]


def test_source_lines(spark):
    text = "[^1] [Context document 1](https://x.y/z)\n\n[^2] no link\n[t](http://u)\n  [^12][ a ]( http://no)\n[^3] [b](http://q )"
    # the title starts at the line's first bracket
    assert entries(spark, text) == [("1", "^1] [Context document 1", "https://x.y/z"), ("3", "^3] [b", "http://q")]
    assert entries(spark, text, clean_titles=True) == [("1", "Context document 1", "https://x.y/z"), ("3", "b", "http://q")]


def test_more_sources_than_symbols(spark):
    sources = "\n".join(f"[^{i}] [t{i}](http://s/{i})" for i in range(1, 13))
    body = " ".join(f"[^{i}]" for i in range(1, 14))
    out = texts(spark, f"{body}\nSources:\n{sources}")
    assert "①" in out[0] and "⑩" in out[0] and out[0].count("•") == 2 and "[^13]" in out[0]
    listed = out[-1].split("\n")
    assert listed[0] == "*References*" and listed[1] == " ① <http://s/1|^1] [t1>"
    assert listed[12] == " • <http://s/12|^12] [t12>" and out[-1].endswith(">\n")


def test_number_under_two_urls_takes_the_later(spark):
    text = "a [^1] b [^2]\nSources:\n[^1] [x](http://a)\n[^2] [y](http://b)\n[^1] [z](http://b)"
    assert texts(spark, text)[0] == "a  ②  b  ②\n"


def test_repeated_url_shares_a_symbol(spark):
    text = "a [^1][^3]\nSources:\n[^1] [x](http://a)\n[^2] [y](http://b)\n[^3] [z](http://a)"
    out = texts(spark, text)
    assert out[0] == "a  ①  ①\n"
    assert out[-1] == "*References*\n ① <http://a|^1] [x>\n ② <http://b|^2] [y>\n"


def test_mrkdwn_changes_headings_in_code_too(spark):
    text = "## Head **x**\n```py\n# note\n```\n_i_ `c`"
    assert value(spark, text, markup.markdown_to_mrkdwn) == "\n*Head *x**\n\n```py\n\n*note*\n\n```\n_i_ `c`"


@pytest.mark.parametrize(
    "text, want",
    [
        ("a\nb\n\nc", ["a\nb", "c\n"]),
        ("a\n```sql\nx\n\n  y\n```\nb", ["a", "```\nsql\nx\n\n  y\n```", "b\n"]),
        ("a\n```\nlost", ["a"]),
        ("```\n```", ["```\n\n\n```"]),
        ("```\n\n```", ["```\n\n\n```"]),
        ("```\n\n\n```", ["```\n\n\n\n```"]),
        ("  ``` py  \nx\n ```x\nb", ["```\n py\nx\n```", "b\n"]),
        ("", []),
        ("a\n \t\n\nb\n   c", ["a", "b\n   c\n"]),
        ("a\n```\nx\n```\n```\ny\n```", ["a", "```\n\nx\n```", "```\n\ny\n```"]),
        ("a\n# Head", ["a", "*Head*"]),
    ],
)
def test_segments(spark, text, want):
    assert texts(spark, text) == want


def test_segments_lose_no_line(spark):
    rng = random.Random(4)
    for _ in range(25):
        lines = rng.choices(["a", "b c", "", "  ", "```", "```py", "  d"], k=rng.randint(1, 14))
        # close what is open, so that nothing may be lost
        if sum(v.strip().startswith("```") for v in lines) % 2:
            lines.append("```")
        kept = [v.strip() for v in lines if v.strip() and not v.strip().startswith("```")]
        made = [
            v.strip()
            for t in texts(spark, "\n".join(lines))
            for v in t.split("\n")
            if v.strip() not in ("", "```", "py")
        ]
        assert made == kept


def test_pages(spark):
    text = "\n\n".join(f"p{i}" for i in range(120)) + "\n\nSources:\n[^1] [t](http://a)"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "response_id long, response string")
    rows = {(r.response_id, r.page_no): r for r in rendering.rendered_pages(df).collect()}
    assert sorted(rows) == [(1, 0), (1, 1), (1, 2), (3, 0)]
    assert [len(rows[1, p].blocks) for p in range(3)] == [50, 50, 22]
    assert rows[1, 0].fallback_text.startswith("p0\n\np1\n\n") and rows[1, 0].fallback_text.endswith("p49")
    assert rows[1, 2].fallback_text.endswith("p119\n\n\n---\n*References*\n ① <http://a|^1] [t>")
    assert rows[3, 0].fallback_text == rendering.FORMAT_NOTICE + "None" and rows[3, 0].blocks == []
    bad = rendering.rendered_pages(df.filter("response_id < 3"), F.col("response_id") == 1).collect()
    assert [r.fallback_text for r in bad] == [rendering.FORMAT_NOTICE + text]


def test_rendering_never_shuffles(spark, sf):
    stored = spark.read.parquet(f"{sf}/conversations.parquet").select(
        F.col("turn").alias("response_id"), F.col("text").alias("response")
    )
    plan = plan_of(rendering.rendered_pages(stored))
    assert "Exchange" not in plan and "Python" not in plan


def test_fixture_reaches_every_variant(spark, sf):
    pages = rendering.rendered_pages(I.responses(spark, sf))
    assert pages.filter("page_no > 0").count() > 0
    assert pages.selectExpr("max(size(blocks))").first()[0] == 50
