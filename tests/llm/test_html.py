import random

import pytest

from corvane.llm import html

SCHEMA = "page_id long, url string, html string, text string"

CASES = [
    ("<article><h1>T</h1><p>a &amp; b&nbsp;c<br>d<p>e <b>f</b>g</article><footer>x</footer>", "T\n\na & b c d\n\ne fg"),
    ("<body><header>H</header><nav><ul><li>m</ul></nav><article><header><h1>T</h1><p>by x</p></header><p>a</p><aside>s</aside><form>f</form><section class='comments'><p>c</p></section></article>", "T\n\nby x\n\na"),
    ("<main><p>a<p>b</main><div>c</div>", "a\n\nb"),
    ("<head><title>t</title><body><p>a<script>var x='</p>'</script>b</p><div class='cookie-notice'>c</div><p>d", "ab\n\nd"),
    ("<article><p class=ad>x<p>a</article>", "a"),
    ("<article><p>a <span hidden>b</span> c<!-- d > --> e</p><div style='display: none'>f</div><article class=\"comment\">g</article></article>", "a c e"),
    ("a < b &lt;p&gt; <p title='>'>c", "a < b <p>\n\nc"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\n\nb\n\nc\n\nd"),
    ("<div role=main><p>a</p></div><p>b</p>", "a"),
    ("<div itemprop='articleBody'>a</div>b", "a"),
    (None, ""),
    ("", ""),
    ("plain  text", "plain text"),
    ("<p><b>T.<br><p>a", "T.\n\na"),
    ("<article><p>" + "w " * 30000 + "</article>", ("w " * 30000).strip()),
    ("<script>never closed", ""),
    ('<article><h2 id="related-work">a</h2><h2 id="notice-period">b</h2><h3 class="social">c</h3><div class="social-history">d</div>', "a\n\nb\n\nc\n\nd"),
    ('<article><p title="a hidden gem">a<p data-id="menu">b<p data-role=navigation aria-hidden=false>c<p hidden>d', "a\n\nb\n\nc"),
    ("<article><header><h1>T</h1><p>Standfirst.</p></header><p>a</article>", "T\n\nStandfirst.\n\na"),
    ("<article>teaser</article><main>body</main>", "body"),
    ("<main><h1>all</h1><article>the long article</article></main><article>x</article>", "the long article"),
    ("<main><article>card</article><p>a long body</main>", "card\n\na long body"),
    ("<div class='layout no-sidebar'><article>a</article></div>", "a"),
    ("<div class='page has-sidebar elementor-widget'><article class='post social'>a<math>x = y</math></article></div>", "ax = y"),
    ("<form><nav>n</nav><article>a<aside>s</aside></article></form>", "a"),
    ("<div class='sidebar'><article>teaser</article></div><article>a</article>", "a"),
    ("<div class=content><p>body</div><section class='comments'><article><p>nice post</article></section>", "body"),
    ("<div class=content><p>body</div><aside><article>teaser</article></aside>", "body"),
    ("<div class=content><p>body</div><div id=comments><article>c1</article><article>c2</article></div>", "body"),
    ("<div id=comments class=x><article>c1</article></div>", ""),
    ("<ol class='comment-list'><li><article>c1</article></ol>", ""),
    ("<div class='sidebar'><article>teaser</article></div><p>body", "body"),
    ("<div class='sidebar'><article>all there is</article></div>", "all there is"),
    ("<article><p>a <span class='ad'>buy</span> b<p>c <span class=ad>buy <b>now</b></span></article>", "a b\n\nc"),
    ("<article><p>a <span class=ad>x<p>y</span> z<p>b</article>", "a\n\nz\n\nb"),
    ("<article><section id='related'>Related work matters</section><p class='social'>Social life of ants<p>b</article>", "Related work matters\n\nSocial life of ants\n\nb"),
    ("<article><div class='promotion'>Promotion to general</div><div id='notice'>N</div><div class='ad-slot'>a slot</div><aside class=related>r</aside></article>", "Promotion to general\n\nN\n\na slot"),
    ("<article><p>a <span class='share'>b</span> c</article>", "a b c"),
    ("<article><ul id=related-comments><li>r</ul><div class='newsletter-signup'>n</div><p>a", "a"),
]


def test_structure(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}/", page, "clash") for i, (page, _) in enumerate(CASES)], SCHEMA)
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_repetition_judges_what_classes_hint_at(spark):
    """In an article a hinted block goes where it stands on several pages of the host, and stays where it does not."""
    teaser = "one two three four five six seven eight nine ten eleven twelve thirteen"
    own = " ".join(f"own{i}" for i in range(20))
    page = lambda hinted, body: f"<article><p>{body}</p><div class='newsletter-box'>{hinted}</div><section id=related>{own} {body}</section><p>end</p></article><footer>f</footer>"
    rows = [(1, "http://a.org/1", page(teaser, "first"), None), (2, "http://a.org/2", page(teaser, "second"), None), (3, "http://b.org/", page(teaser, "third"), None)]
    rows += [(4, "http://a.org/4", f"<article><p>{teaser}</p></article>", None)]  # not hinted at: stays, whatever repeats
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "first\n\nfirst\n\nend", 2: "second\n\nsecond\n\nend", 3: f"third\n\n{teaser}\n\n{own} third\n\nend", 4: teaser}


def brute(pages):
    """Texts of unmarked pages: what no string of LEAST tokens covers that stands on two distinct pages of the host."""
    where, streams = {}, []
    for key, (host, paragraphs) in enumerate(pages):
        tokens = [w for p in paragraphs for w in p.split()]
        streams.append(tokens)
        for i in range(len(tokens) - html.LEAST + 1):
            where.setdefault((host, *tokens[i : i + html.LEAST]), set()).add((key, host, tuple(paragraphs)))
    out = []
    for (host, paragraphs), tokens in zip(pages, streams):
        gone = [False] * len(tokens)
        for i in range(len(tokens) - html.LEAST + 1):
            if len(where[(host, *tokens[i : i + html.LEAST])]) > 1:
                gone[i : i + html.LEAST] = [True] * html.LEAST
        at, kept = 0, []
        for p in paragraphs:
            words = p.split()
            left = [w for w, g in zip(words, gone[at:]) if not g]
            at += len(words)
            kept += [" ".join(left)] if left else []
        out.append("\n\n".join(kept))
    return out


@pytest.mark.parametrize("held", [html.HELD_RUNS, 3])
def test_boilerplate_equals_brute_force(spark, tmp_path, monkeypatch, held):
    monkeypatch.setattr(html, "HELD_RUNS", held)
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3)
    shared = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(4)]
    pages = []
    for _ in range(50):
        paragraphs = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(3)]
        paragraphs.insert(rng.randint(0, 3), rng.choice(shared))
        pages.append((rng.choice(["one.org", "two.org", "three.org"]), paragraphs))
    pages.append(("one.org", ["ab cd " * 30]))  # repeats within one page are no boilerplate
    rows = [(i, f"https://{h}/x", "".join(f"<p>{p}</p>" for p in ps), None) for i, (h, ps) in enumerate(pages)]
    rows += [rows[4], (None, None, None, None), (99, "http://one.org/", f"<article>{shared[0]}</article>", None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((str(r.page_id), r.text) for r in html.op5_html(spark, str(tmp_path)).collect())
    want = brute(pages)
    assert got == sorted([(str(i), t) for i, t in enumerate(want)] + [("4", want[4]), ("None", ""), ("99", shared[0])])


def test_empty_table(spark):
    assert html.extract(spark.createDataFrame([], SCHEMA)).count() == 0
