"""Operators and stages do the whole job: nothing is lost, nothing is left in."""

import time

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from gridverify.llm import html_extract, pfair, sharding
from gridverify.llm.common import staged


def test_pipeline_mix_keeps_every_document(spark):
    """One source of a single row, a null source of three, a hot third, and five equal sources."""
    source = (
        F.when(F.col("id") == 0, "stray").when(F.col("id") < 4, None)
        .when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5))
    )
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), source.alias("source"))
    rows = corpus_pipeline.mixing(spark, docs, "").collect()
    assert sorted(r.doc_id for r in rows) == list(range(6000))
    # The others go on in the ratio of their weights: of the first half, the hot source has its weight.
    n = {s: sum(r.source == s for r in rows) for s in {r.source for r in rows}}
    weight = {s: c**pfair.POWER for s, c in n.items()}
    half = sum(r.source == "hot" for r in rows[:2000]) / 2000
    assert abs(half - weight["hot"] / sum(weight.values())) < 0.02
    assert {r.source for r in rows[-200:]} == {"hot"}
    given = pfair.mixed(docs, {"stray": 1, "hot": 1})
    assert given.count() == 8 + 1 + 8


WRAPPERS = [
    "<article class='post comments-open'>", "<div class='page has-sidebar'>", "<main class='no-sidebar'>", "<div class='container header-fixed'>",
    "<div id='search-results'>", "<div class='share-price'>", "<div class=social-science>", "<article class=related>", "<div class=notice>", "<main id=search>",
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_wrappers_do_not_hide_the_article(wrapper):
    end = f"</{wrapper[1:].split()[0]}>"
    page = f"<body><nav>menu</nav><div class=ad-box>buy</div><p>stray</p>{wrapper}<h1>Title</h1><p>A long enough first paragraph.</p><p>And one more.</p></div>{end}<div class='site-footer'>foot</div>"
    text = html_extract.Page(page).text(None)
    assert "Title\nA long enough first paragraph.\nAnd one more." in text and "buy" not in text and "foot" not in text


def test_left_out_by_name():
    text = lambda page: html_extract.Page(page).text(None)
    # A discussion may be longer than the article; what is left alone comes back.
    talk = "<div class='comments-area'><p>" + "I say so too. " * 20 + "</p></div>"
    assert text(f"<div class=post><p>The article.</p></div>{talk}") == "The article."
    assert text(talk) == ("I say so too. " * 20).strip()
    for name in ("comments", "related-posts", "site-footer", "cookie-banner", "ad-12", "share_buttons", "sidebar left"):
        assert text(f"<div class=post><p>The article, which is longer.</p><div class='{name}'>left out</div></div>") == "The article, which is longer."


LEAD = "<h1>Title</h1><p>A lead of the page.</p>"
BODY = "<p>" + "A long body of the text. " * 20 + "</p>"
TEXT = "Title\nA lead of the page.\n" + ("A long body of the text. " * 20).strip()
NESTED = [
    (f"<article>{LEAD}<section>{BODY}</section></article>", TEXT),
    (f"<main><article>{LEAD}<section><div>{BODY}</div></section></article></main>", TEXT),
    (f"<main>{LEAD}<article>{BODY}</article></main>", TEXT),
    (f"<div class=content>{LEAD}<div class=body>{BODY}</div></div>", TEXT),
    (f"<article>{LEAD}<section>{BODY}</section><section><p>End</p></section></article>", TEXT + "\nEnd"),
    # Links beside the text, and text beside the article, do not widen it.
    (f"<div><div class=list><a href=a>one page</a> <a href=b>another page</a></div><div class=body>{LEAD}{BODY}</div></div>", TEXT),
    (f"<div class=welcome><p>Welcome to this site.</p></div><article>{LEAD}<section>{BODY}</section></article>", TEXT),
]


@pytest.mark.parametrize("number", range(len(NESTED)))
def test_title_and_lead_around_a_long_section_stay(number):
    page, expected = NESTED[number]
    best = html_extract.Page(page).best()
    assert html_extract.Page(page).text(best[0]) == html_extract.Page(page).text(None) == expected


def test_title_and_lead_of_a_host(spark):
    pages = [(k, "http://h/x", NESTED[0][0]) for k in range(3)]
    found = html_extract.with_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert [r["__text"] for r in found] == [TEXT] * 3


def hostile(n: int) -> dict[str, tuple[str, str]]:
    """Pages of markup that is never ended, or nested or repeated n times, and their text."""
    return {
        "tags without end": ("<a " * n, ("<a " * n).strip()),
        "names without end": ("<a" * n, "<a" * n),
        "quotes that hide every end": ('<a ">"' * n, '"' * n),
        "declarations without end": ("<!x " * n, ("<!x " * n).strip()),
        "comment without end": ("<a <!-- " * n, "<a"),
        "nested": ("<div class=x>" * n + "text", "text"),
        "nested with text": ("<div class=x><p>word</p>" * n, "word\n" * (n - 1) + "word"),
        "nested discussions": ("<div class=comments>x" * n, "x\n" * (n - 1) + "x"),
        "stray ends": ("<b>" * n + "</i>" * n + "text", "text"),
        "blocks in open spans": ("<b>" * n + "<h1>x</h1>" * n, "x\n" * (n - 1) + "x"),
        "items beyond open spans": ("<ul><li>" + "<ul>" + "<b>" * n + "<li>x</li>" * n, "x\n" * (n - 1) + "x"),
        "script without end": ("text<script " * n + ">", "text"),
    }


@pytest.mark.parametrize("name", sorted(hostile(1)))
def test_hostile_pages_take_linear_time(name):
    """Eight times the page takes far less than 64 times as long, and its text is whole."""
    seconds = []
    for n in (4_000, 32_000):
        page, expected = hostile(n)[name]
        start = time.process_time()
        read = html_extract.Page(page)
        assert read.text(None) == expected
        assert read.text(read.best()[0]) == expected
        seconds.append(time.process_time() - start)
    assert seconds[1] < 24 * seconds[0] + 0.3


def test_references_to_long_numbers():
    page = "<p>a &#" + "9" * 9000 + "; b &#" + "0" * 9000 + "65; c &#x41; &amp; &#0;</p>"
    assert html_extract.Page(page).text(None) == "a \ufffd b A c A & \ufffd"


@pytest.mark.parametrize("quoted", ['<p a="x>y">text</p>', "<p a='x>y' b=\">\">text</p>", '<p a="x>text</p>', "<p a=x>text</p>"])
def test_ends_of_tags_by_pattern_and_by_table(quoted):
    """The table, made after a tag whose quotes leave no end, gives the ends that the pattern gives."""
    assert html_extract.Page(quoted).text(None) == "text"
    found = html_extract.WHOLE_TAG.match(quoted)
    expected = quoted.index(">") if found[5] is None else found.end() - 1
    assert html_extract.Ends(quoted).find(2) == expected
    page = html_extract.Page(quoted + "<i title='>")
    assert page.text(None) == "text"


def test_classes_with_markup_in_them():
    page = "<div class='a>b'><p>The text of the page.</p></div>"
    best = html_extract.Page(page).best()
    assert best[0].count(">") == 1 and html_extract.Page(page).text(best[0]) == "The text of the page."


@pytest.mark.parametrize("stored", [True, False])
def test_shards_follow_the_mix(spark, monkeypatch, stored):
    """Slots of each shard go on in the order of the schedule, whether the mix is stored between or not."""
    monkeypatch.setattr(sharding, "STRETCH_BITS", 4)
    source = F.when(F.col("id") < 300, "few").when(F.col("id") % 50 == 0, None).otherwise("many")
    text = F.repeat(F.lit("word "), (F.col("id") % 7).cast("int"))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(text, (F.col("id") % 900).cast("string")).alias("text"), source.alias("source"), F.lit(1).alias("_metadata"))
    docs = staged(docs, "mix-test")
    mix = corpus_pipeline.mixing(spark, docs, "")
    place = {r.doc_id: i for i, r in enumerate(mix.select("doc_id").collect())}
    if stored:
        mix = staged(mix, "mix-test")
    rows = corpus_pipeline.sharding_stage(spark, mix, "").collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    for s in range(8):
        mine = sorted((r for r in rows if r.shard == s), key=lambda r: r.shard_slot)
        assert [r.shard_slot for r in mine] == list(range(len(mine))) and len(mine) > 100
        places = [place[r.doc_id] for r in mine]
        assert places == sorted(places)
        # At first a shard has about the sixth of the few that the mix has.
        assert 0.08 < sum(r.source == "few" for r in mine[:100]) / 100 < 0.28
