import random

import pytest

from loomlog.llm import pages as M

STORY = "This is the story of a man who was in the house and that is the end of it all for now, and there is a lot of text that is in the page for you to read. It goes on with the others for the whole of the day."
MORE = "And this is the second long paragraph of the text in which it is said that the man was not in the house at all, but he had been in the garden with the others for the whole of the day and into the night."

CASES = [
    (None, ""), ("", ""), ("   ", ""), ("<p></p>", ""), ("no markup at all", "no markup at all"),
    (f"<nav><a href='/x'>menu</a></nav><article><h1>A headline</h1><p>{STORY}<p>Short.<p>{MORE}</article><footer>&copy; 2020</footer>", f"A headline\n{STORY}\nShort.\n{MORE}"),
    (f"<div class='content'><p>{STORY}</p><p>So it was.</p><p>{MORE}</p></div><div class='sidebar'><p>{MORE}</p></div>", f"{STORY}\nSo it was.\n{MORE}"),
    (f"<article><p>a &amp;&lt;b&gt; c&nbsp;&eacute; \n\t d {STORY}</p></article>", f"a &<b> c é d {STORY}"),
    (f"<script>var t='<p>{STORY}</p>';</script><style>p{{}}</style><article><p>{STORY}</p></article>", STORY),
    (f"<article><p>{STORY}</p><section class='comments'><p>{MORE}</p></section><form><p>{MORE}</p></form><div class='ad-box'>{MORE}</div></article>", STORY),
    (f"<header><p>{MORE}</p></header><div id='cookie-notice'>{MORE}</div><main><header><h1>Title</h1></header><p>{STORY}</p><aside>{MORE}</aside></main>", f"Title\n{STORY}"),
    (f"<article><p>{STORY}<!-- <p>{MORE}</p> --></p></article>", STORY),
    (f"<ARTICLE><P>{STORY}</P></ARTICLE><!-- never closed {MORE}", STORY),
    (f"<article><p>{STORY}</article><script>never closed {MORE}", STORY),
    (f"<article><p title=\"a > b\">{STORY}</p></article>", STORY),
    ("<article><p>1 < 2 and 3 > 2, says the article in the paper of the day, and that is it for now.</p></article>", "1 < 2 and 3 > 2, says the article in the paper of the day, and that is it for now."),
    ("<article><p>Be.</p><p>Go.</p></article><footer>the end of the page and all of it</footer>", "Be.\nGo."),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_cases(case):
    assert M.main_text(CASES[case][0]) == CASES[case][1]


def test_open_blocks_follow_their_nearest_neighbours():
    found = [M.Block(x, 0, 0, False) for x in (STORY, "The end of it", "More of it", "xx zz ww " * 60, "What is it", "zz xx ww " * 60)]
    assert [b.label for b in M.label(found)] == [True, True, False, False, False, False]


def test_links_make_a_block_a_menu():
    links = " ".join(f"<a href='/{i}'>the story of it and all</a>" for i in range(12))
    assert M.main_text(f"<div>{links}</div><div>{STORY}</div>") == STORY


def test_broken_markup_never_crashes_and_long_pages_pass():
    rng = random.Random(1)
    for _ in range(300):
        M.main_text("".join(rng.choice(["<p>", "</p>", "<div class=x", "<", ">", "&", "&#x110000;", "a b", "</", "<!--", "'", '"', "<b>", "<li>", "<article>", "</article>"]) for _ in range(40)))
    long = f"<p>{STORY}</p>" * 3000
    assert M.main_text(f"<article>{long}</article>") == "\n".join([STORY] * 3000)


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", CASES[5][0], "c"), (1, "u", CASES[5][0], "c"), (None, None, None, "c")], "page_id long, url string, html string, text string")
    got = M.extract(df).collect()
    assert sorted(r.n_chars for r in got) == sorted([0, len(CASES[5][1]), len(CASES[5][1])]) and {r.text for r in got} == {"", CASES[5][1]}
    assert M.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("attributes", ['style="overflow:hidden"', 'title="the hidden truth"', 'data-hidden="no"', 'data-id="sidebar"', "data-class=comments", 'data-x="a" style="overflow: hidden"'])
def test_only_whole_attribute_names_mark_an_element(attributes):
    assert M.main_text(f"<div {attributes}><article><p>{STORY}</p></article></div>") == STORY


@pytest.mark.parametrize("attributes", ["hidden", "HIDDEN", 'hidden=""', 'aria-hidden="true"', 'style="x" hidden', "id=sidebar", 'CLASS = "nav"'])
def test_marked_elements_go(attributes):
    assert M.main_text(f"<div {attributes}><p>{MORE}</p></div><article><p>{STORY}</p></article>") == STORY


def test_ids_inside_an_article_are_its_own():
    page = f'<article><h2 id="related-work" class="share">Related work</h2><p>{STORY}</p><section id="privacy"><p id="search-results" class="notice">{MORE}</p></section><div class="comments">{MORE}</div></article>'
    assert M.main_text(page) == f"Related work\n{STORY}\n{MORE}"


PROSE = "The council of the town met on Monday and it was agreed that the bridge should be mended before the winter, as many of the people who live on the other side of the river have no other way to work. " * 2
PROSE = PROSE.strip()


def test_forms_and_long_names_are_weighed():
    """What a doubtful container holds decides: prose and articles stay, boxes, buttons and reader comments go."""
    assert M.main_text(f'<body><form id="aspnetForm"><div><p>{PROSE}</p><p>{PROSE}</p></div><input></form></body>') == f"{PROSE}\n{PROSE}"
    assert M.main_text(f"<form><article><h2>A bridge</h2><p>{PROSE}</p></article></form>") == f"A bridge\n{PROSE}"
    for inside in (f'<div class="share-content"><p>{PROSE}</p></div>', f'<ul class="search-results-list"><li>{PROSE}</li></ul>', f'<div class="notice-board"><p>{PROSE}</p></div>', f"<object><p>{PROSE}</p></object>", f"<label>{PROSE}</label>"):
        assert M.main_text(f"<article><p>{PROSE}</p>{inside}</article>") == f"{PROSE}\n{PROSE}"
    for inside in (
        '<div class="share">Share this with all of the people who are on it</div>', '<div class="share-buttons"><a href="x">Tweet</a> <a href="y">Post</a></div>',
        "<form><label>Your mail</label><input><button>Go</button></form>", f'<div class="comment-list"><p>{PROSE}</p></div>', f'<div class="notice">{PROSE}</div>',
        f'<form><div class="comments">{PROSE}</div></form>', f"<form><p>{PROSE}</p></form>", f'<div class="related-links"><a href="x">{PROSE}</a></div>', f"<form hidden>{PROSE}</form>",
    ):
        assert M.main_text(f"<article><p>{PROSE}</p>{inside}</article>") == PROSE, inside
    # a container inside a doubtful one stands only if both do
    assert M.main_text(f'<article><p>{PROSE}</p><form><div class="share-box">Post it on the wall</div></form></article>') == PROSE
    assert M.main_text(f'<form><p>{PROSE}</p><article><div class="notice-board"><p>{PROSE}</p></div></article></form>') == f"{PROSE}\n{PROSE}"


def test_open_blocks_between_equally_near_neighbours():
    """On a tie the block before decides."""
    short = "Two words"
    page = f"<p>{PROSE}</p><p>{short}</p><p>{'qqq xyz ' * 30}</p>"
    assert M.main_text(page) == f"{PROSE}\n{short}"
    assert M.main_text(f"<p>{'qqq xyz ' * 30}</p><p>{short}</p><p>{PROSE}</p>") == PROSE
