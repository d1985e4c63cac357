import pytest

from seekspark.llm.html_text import extract_main_text, main_text

CASES = [
    (None, ""),
    ("", ""),
    ("plain text only", "plain text only"),
    ("<p>one<nav>menu</nav><p>two <b>bo</b>ld", "one\ntwo bold"),
    ("<title>t</title><style>p{}</style><script>var t='</p>';</script><p>x &lt;b&gt; &amp; &eacute;&#233;</p>", "x <b> & éé"),
    ("<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul><article><h1>Head</h1><p>a\n  b<br>c</p></article><footer>f</footer>", "Head\na b c"),
    ("<article><p>short</p></article><div>" + "long menu words " * 50 + "</div>", "short"),
    ("<article><p>a</p><div class='ad'>buy</div><p>b</p><div class=comments><p>nice</p></div></article>", "a\nb"),
    ("<header>h</header><main><form>f <input></form><p>body</p></main><aside>s</aside>", "body"),
    ("<div role=navigation>n</div><div id='cookie-notice'>c</div><p>text here</p>", "text here"),
    ("<p>unclosed <i>markup<p>next</div></i></section> tail", "unclosed markup\nnext\ntail"),
    ("<!-- <p>no</p> --><p>yes</p><!-- open", "yes"),
    ("<p>a < b and c > d</p>", "a < b and c > d"),
    ("<nav>only menus</nav>", ""),
]


@pytest.mark.parametrize("page,expected", CASES)
def test_main_text(page, expected):
    assert main_text(page) == expected


def test_heaviest_run_is_kept_without_an_article_element():
    menu = "".join(f"<div><a href={i}>Item {i}</a></div>" for i in range(30))
    body = "".join(f"<p>Sentence {i} of a long enough running text.</p>" for i in range(20))
    text = main_text(f"<body>{menu}<header>x</header>{body}<footer>y</footer></body>")
    assert text.split("\n") == [f"Sentence {i} of a long enough running text." for i in range(20)]


def test_an_article_element_adds_weight_but_does_not_decide():
    long = "A sentence of the post. " * 100
    card = "<article class=card><p>Read next</p></article>"
    for post in (f"<div class=post><p>{long}</p></div>", f"<div class=post>{long}</div>", "<div class=post><p>" + "word " * 100 + "</p></div>"):
        expected = " ".join(post.replace("<div class=post>", "").replace("<p>", "").replace("</p>", "").replace("</div>", "").split())
        assert main_text(post + card) == expected
        assert main_text(card + post) == expected
    parts = f"<article><p>{long}</p><div class=ad>buy</div><p>end</p></article><div><p>A note.</p></div>"
    assert main_text(parts) == f"{long.strip()}\nend"


def test_deep_and_unmatched_tags_stay_linear():
    assert main_text("<b>" * 50_000 + "</i>" * 50_000 + "<p>x" * 10) == "\n".join("x" * 10)


def test_extraction_keeps_every_row(spark):
    rows = [(1, "u", "<p>é a</p>", "clash"), (1, "u", "<p>é a</p>", "clash"), (None, None, None, None), (2, "v", "", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = extract_main_text(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in found.collect()) == [
        (0, "", 0), (1, "é a", 3), (1, "é a", 3), (2, "", 0)
    ]
    assert extract_main_text(pages.limit(0)).count() == 0
