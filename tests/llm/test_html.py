import pytest

from curbscope.llm import html_crf, html_pages


@pytest.fixture(scope="module")
def model():
    return html_crf.default_model(pages=250)


def test_held_out_pages(model):
    wrong = total = 0
    for html, gold in html_pages.labelled(150, seed=12345):
        found = html_crf.blocks(html)
        assert gold <= {t for t, _, _ in found}
        states = model.decode(html_crf.features(found))
        wrong += sum(s != (t in gold) for (t, _, _), s in zip(found, states))
        total += len(found)
    assert wrong / total < 0.015


def test_viterbi_is_the_best_of_all_sequences(model):
    from itertools import product

    for html, _ in html_pages.labelled(12, seed=77):
        f = html_crf.features(html_crf.blocks(html))[:9]

        def value(states):
            own = sum(model.emit[[model.number[x] for x in b if x in model.number], s].sum() for b, s in zip(f, states))
            return own + model.start[states[0]] + sum(model.move[a, b] for a, b in zip(states, states[1:]))

        best = max(product((0, 1), repeat=len(f)), key=value)
        assert value(tuple(model.decode(f))) == pytest.approx(value(best))


def test_blocks_of_broken_markup():
    texts = lambda h: [t for t, _, _ in html_crf.blocks(h)]
    assert texts("<p>one<p><b>two\n three<br>four<p>&eacute;&#233;&amp;amp;</b> x") == ["one", "two three four", "éé&amp; x"]
    assert texts("<script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><p>yes") == ["yes"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e<tr><td>f</table>tail") == ["a", "b", "c", "d", "e", "f", "tail"]
    assert texts("<p>cut off <a href='x") == texts("<p>cut off <!-- x > <p>y") == ["cut off"]
    assert texts("<script><!-- x</script><p>a < b &lt; c") == ["a < b < c"]
    path = html_crf.blocks("<article><p><b>x</article><footer>y")
    assert [t for t, _ in path[1][2]] == ["footer"]


PAGES = [
    (1, "u", '<html><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy now, buy more of this.</div><article><h1>A title here</h1>'
             "<p>First  paragraph &amp; more text.</p><p>Second one.</p><section class=\"comments\"><p>I think so too.</p></section></article>"
             "<footer>&copy; x</footer></body></html>"),
    (1, "u", None), (None, None, ""), (2, "v", "   "), (3, "w", "<nav><a href=x>only</a></nav>"),
]


def test_query_rows(spark, model):
    df = spark.createDataFrame([(*p, "t", 1) for p in PAGES], "page_id long, url string, html string, text string, n_chars int")
    got = html_crf.extract(df, model=model)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = sorted(map(tuple, got.collect()), key=repr)
    want = "A title here\nFirst paragraph & more text.\nSecond one."
    assert (1, "u", want, len(want)) in rows
    assert sum(r[3] == 0 for r in rows) == 4 and len(rows) == 5
    assert html_crf.extract(df.limit(0), model=model).count() == 0


def test_very_long_pages(model):
    html = "<article>" + "".join(f"<p>Paragraph number {k} of the text.</p>" for k in range(20_000)) + "</article>"
    assert html_crf.main_text(html, model).count("\n") == 19_999


def test_pages_without_end_tags(model):
    texts = lambda h: [t for t, _, _ in html_crf.blocks(h)]
    assert texts("<html><head><title>t</title><meta name=a><body><p>one</p><p>two") == ["one", "two"]
    assert texts("<head><title>t</title><link rel=x>text<p>one") == ["text", "one"]
    assert texts("<head><template><div>no</div></template><title>t</title><div>one</div>") == ["one"]
    assert texts("<div><button>b<p>one</p></div><div><object><p>two</div><svg><text>x</text><p>three") == ["b", "one", "two", "x", "three"]
    assert texts("<p>a <math><mi>y</mi></math></p><noscript><p>b</noscript><div><template>no</div><p>c") == ["a", "y", "b", "c"]
    for html, _ in html_pages.labelled(20, seed=4):
        open_head = html.replace("</head>", "")
        assert open_head != html and html_crf.main_text(open_head, model) == html_crf.main_text(html, model) != ""
