"""Wrapper inference against regular expressions, and texts that only the wrapper can tell apart."""

import random
import re
import time

from lodestone.llm import wrappers


def pattern(parts):
    """The wrapper as a regular expression over ``stream``."""
    out = []
    for p in parts:
        if p[0] == "e":
            out.append(f"<{p[1]} {p[2]}>{pattern(p[3])}</{p[1]}>")
        elif p[0] == "t":
            out.append("T" if p[1] is None else f"(?:{p[1]})")
        elif p[0] in "?+":
            out.append(f"(?:{pattern(p[1])}){p[0]}")
        else:
            out.append(p[0])
    return "".join(out)


def stream(forest, digests):
    out = []
    for x in forest:
        if wrappers.is_element(x):
            out.append(f"<{x[0][1]} {' '.join(x[0][2])}>{stream(x[1], digests)}</{x[0][1]}>")
        elif x[0] != "t":
            out.append(x[0])
        elif x[1] != " ":
            d = wrappers.digest(x[1])
            out.append(d if d in digests else "T")
    return "".join(out)


def generated(wrapper, page):
    kept = re.findall(r"\(\?:([0-9a-f]{24})\)", pattern(wrapper))
    forest = wrappers.elements(wrappers.tokens(page))
    loose = pattern(wrapper).replace("T", "(?:T|[0-9a-f]{24})")
    return re.fullmatch(loose, stream(forest, set(kept))) is not None


def infer_read(pages):
    w = wrappers.Wrapper(wrappers.infer(pages))
    return [w.read(p) for p in pages]


def test_inference():
    one, two = ("<ul><li>a</li><li>b</li></ul><p>t1</p>", "<ul><li>c</li></ul><h2>x</h2><p>t2</p>")
    w = wrappers.infer([one, two])
    assert [p[0] for p in w] == ["e", "?", "e"] and w[0][3][0][0] == "+" and w[2][3] == [["t", None, 4]]
    for page in (one, two, "<ul>" + "<li>z</li>" * 9 + "</ul><p>q</p>"):
        assert generated(w, page)
    assert not generated(w, "<table></table>") and not generated(w, "<p>q</p>")


def test_wrappers_generate_their_pages():
    """On small random pages: each page that a wrapper was inferred from matches it as a regular expression."""
    r = random.Random(6)

    def page(depth=3):
        out = []
        for _ in range(r.randint(0, 4)):
            tag = r.choice(["p", "div", "ul", "b", "h2"])
            if depth and tag in ("div", "ul"):
                out.append(f'<{tag} class="{r.choice("xy")}">{page(depth - 1)}</{tag}>' * r.choice([1, 1, 3]))
            else:
                out.append(f"<{tag}>{r.choice(['same', 'text', str(r.random())])}</{tag}>")
        return "".join(out)

    for _ in range(150):
        pages = [page() for _ in range(r.randint(1, 5))]
        w = wrappers.infer(pages)
        assert all(generated(w, p) for p in pages)


def test_the_wrapper_decides():
    """Nothing is marked: of the same blocks, those go that the host's other pages hold as well."""
    a = [f"<div class='q{k}'>Top of the site, on every page</div><div class='x1'>News number {k} of the day</div><p>And then the story {k} goes on</p>" for k in range(4)]
    b = [f"<div class='q{k}'>Words {k} of a different kind for each</div><div class='x1'>News number 2 of the day</div>" for k in range(4)]
    assert infer_read(a)[2] == "News number 2 of the day\nAnd then the story 2 goes on"
    assert infer_read(b)[2] == "Words 2 of a different kind for each"
    other = wrappers.Wrapper(wrappers.infer(b))
    assert other.read(a[2]) != infer_read(a)[2]
    # A marked host's wrapper gives no text of a page that it doesn't match.
    marked = wrappers.Wrapper(wrappers.infer(["<body><div><article><p>one</p></article></div></body>", "<body><div><article><p>two</p></article></div></body>"]))
    assert marked._text(wrappers.elements(wrappers.tokens("<body><section><article><p>one</p></article></section></body>"))) is None
    # A block that all articles share is part of the article, however many there are.
    c = [f"<article><h1>Head {k}</h1><div class='zork'>Zork our plugh</div>" + f"<p>Long text {k} {'of words ' * 20}</p>" * 2 + "</article>" for k in range(6)]
    assert infer_read(c)[3].split("\n")[:3] == ["Head 3", "Zork our plugh", ("Long text 3 " + "of words " * 20).strip()] and infer_read(c[:2])[1] == infer_read(c)[1]
    # Copies of one article but for a date stay whole.
    d = [f"<article><h1>May {k}</h1><p>{'The copied article. ' * 5}</p></article>" for k in range(9)]
    assert infer_read(d)[4] == "May 4\n" + ("The copied article. " * 5).strip()
    # A list of links is a menu where nothing is marked, and part of the text in an article.
    e = [f"<ul><li><a>go {k}</a></li><li><a>to {k}</a></li></ul><p>some words {k}</p>" for k in range(3)]
    assert infer_read(e)[1] == "some words 1" and infer_read([f"<article>{x}</article>" for x in e])[1] == "go 1\nto 1\nsome words 1"


def test_numbers_in_names():
    pages = [f"<div id='post-{k}'><article id='a{k}'><p>text {k}</p></article></div>" for k in range(50)]
    w = wrappers.infer(pages)
    assert len(w) == 1 and len(w[0][3]) == 1 and infer_read(pages) == [f"text {k}" for k in range(50)]


def test_deep_and_wide():
    begun = time.time()
    deep = ["<div>" * 5_000 + f"deep {k}<p>more</p>" + "<nav>menu</nav>" + "</div>" * 5_000 for k in range(2)]
    assert infer_read(deep)[1].split("\n")[0] == "deep 1" and "menu" not in infer_read(deep)[1]

    def wide(seed):
        r = random.Random(seed)
        return "<article>" + "".join(f'<p class="{r.choice("abcdefgh")}{r.choice("xyz")}">t{i}</p>' for i in range(20_000)) + "</article>"

    assert [x.count("\n") for x in infer_read([wide(1), wide(2)])] == [19_999, 19_999]
    assert wrappers.Wrapper([]).read("<p>" * 50_000 + "x").endswith("x")
    assert time.time() - begun < 60


def test_parts_in_common():
    r = random.Random(2)
    for n in (5, 40, 300):
        for _ in range(20):
            a, b = ([r.choice("abcdefghijklmnopqrstuvwxyz")[: 1] * r.randint(1, 3) for _ in range(n)] for _ in range(2))
            got = wrappers.common_parts(a, b)
            assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
            assert wrappers.common_parts(a, a) == [(i, i) for i in range(n)]


def test_extract_edges(spark):
    rows = [(1, None, None, "x"), (2, "http://a.b/", "", "x"), (2, "http://a.b/", "<p>x", "y"), (None, "a", "<article>y &amp; z</article>", None), (5, "http://c.d", "<p>" + "w " * 200_000, "z")]
    out = wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.text[:5], r.n_chars) for r in out) == [(0, "y & z", 5), (1, "", 0), (2, "", 0), (2, "x", 1), (5, "w w w", 399_999)]


OUTSIDE = "<header class='site-header'>Top</header><nav><ul><li><a>Home</a></li></ul></nav><div class='cookie-banner'>We use cookies</div>"
BELOW = "<div class='widget-area'>Widgets</div><section id='comments' class='comments-area'><article class='comment'>A reader says much more than the article does, on and on {k}</article></section><footer>(c)</footer>"


def pages_of(opening, n, around=("", ""), closing="</article>"):
    body = "<h1>Title {k}</h1><h2>Ingredients</h2><p>Some text {k} of words.</p><div class='related-posts'>See also</div><h2>Method</h2><p>More text {k}.</p>"
    return [f"<html><body class='no-sidebar search'>{OUTSIDE}{around[0]}{opening}{body}{closing}{around[1]}{BELOW}</body></html>".replace("{k}", str(k)) for k in range(n)], [f"Title {k}\nIngredients\nSome text {k} of words.\nMethod\nMore text {k}." for k in range(n)]


def test_article_text_is_never_lost():
    """Words on an article or around it, and headings that all articles share, at any number of pages of a host."""
    articles = ["post", "post category-social", "post tag-discussion", "post category-search", "post comments-open", "hentry has-related-media", "sidebar-left-layout post"]
    for words in articles:
        for n in (1, 2, 4, 5, 50):
            pages, want = pages_of(f"<article class='{words}'>", n)
            assert infer_read(pages) == want, (words, n)
    arounds = [("<div class='content-area no-sidebar'>", "</div>"), ("<div class='page-content has-sidebar'>", "</div>"), ("<div class='widget layout'>", "</div>"), ("<form id='aspnet'>", "</form>"), ("<section class='search'>", "</section>"), ("<main class='with-sidebar'>", "</main>")]
    for around in arounds:
        for n in (1, 5, 7):
            pages, want = pages_of("<article>", n, around)
            assert infer_read(pages) == want, (around, n)
    pages, want = pages_of("<div class='post-content'>", 6, arounds[0], "</div>")
    assert infer_read(pages) == want


def test_words_inside_an_article():
    kept = ["share-prices", "banner-year", "related-work", "alerts", "discussion", "category-social", "no-comments-yet"]
    gone = ["share-buttons", "advert", "related-posts", "comments", "comments-area", "post-comments", "cookie-notice", "newsletter-box", "sidebar left", "ad-3", "social", "notice"]
    for n in (1, 6):
        pages = ["<article><h1>T %d</h1>" % k + "".join(f"<div class='{w}'>Text of {w} {k}</div>" for w in kept + gone) + "<object><p>fallback</p></object><map><p>in a map</p></map></article>" for k in range(n)]
        assert infer_read(pages) == ["\n".join(["T %d" % k, *(f"Text of {w} {k}" for w in kept), "fallback", "in a map"]) for k in range(n)]


def test_random_sites_as_their_generator_tells():
    """Pages put together from parts of which each says whether it is main text: all of it comes, and nothing else."""
    r = random.Random(9)
    parts = [(True, "<p>{}</p>"), (True, "<div class='body-{}'><h3>Same</h3><blockquote>{}</blockquote></div>"), (True, "<ul><li>{}</li><li>{}</li></ul>"), (True, "<table><tr><td>{}</td></tr></table>"), (False, "<aside>{}</aside>"), (False, "<div class='ads'>{}</div>"), (False, "<script>x('{}')</script>"), (False, "<div id='share-bar'><a>{}</a></div>"), (False, "<form><input value='{}'>Sign up</form>")]
    for site in range(25):
        shape = [r.choice(parts) for _ in range(r.randint(1, 7))] + [parts[0]]
        tag = r.choice(["article", "main", "div class='entry-content'"])
        pages, want = [], []
        for k in range(r.choice([1, 2, 5, 9])):
            own = [(m, t.replace("{}", f"text{k} {r.random()}")) for m, t in shape for _ in range(r.choice([1, 1, 2]))]
            pages.append(f"<body>{OUTSIDE}<div class='page has-sidebar'><{tag}>" + "".join(t for _, t in own) + f"</{tag.split()[0]}></div>{BELOW}</body>".replace("{k}", str(k)))
            want.append("\n".join(re.sub(r"\s+", " ", x) for m, t in own if m for x in re.findall(r">([^<>]+)<", t)))
        assert infer_read(pages) == want, (site, tag)
