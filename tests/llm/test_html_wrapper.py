from strideway.llm import html_wrapper as H


def page(k, body, notice="Same notice on all pages."):
    return (
        f"<!DOCTYPE html><html><head><title>T{k}</title><script>var a='</p>';</script></head><body><header>Site {k}</header><nav><ul><li><a>n{k}</a></li><li><a>x</a></li></ul></nav>"
        f"<div class='story'><div class=\"notice\">hi</div><div class='top'><p>{notice}</p></div>{body}</div><div class='comments'><p>first! {k}</p></div><footer>f{k}</footer></body></html>"
    )


def test_constants_are_template_and_slots_content():
    pages = [page(k, f"<h1>Title {k}</h1><p>Words of page {k} &amp; more, at some length to be sure.</p><ul><li>item {k}</li></ul>") for k in range(5)]
    wrapper = H.Wrapper.load(H.induce(pages))
    got = H.main_text(pages[2], wrapper)
    assert got == "Title 2\nWords of page 2 & more, at some length to be sure.\nitem 2"
    other = page(9, "<p>Only &lt;one&gt;\n\n  paragraph here that is long enough</p>")
    assert H.main_text(other, wrapper) == "Only <one> paragraph here that is long enough"


def test_broken_markup():
    html = "<html><body><nav><a>m</a></nav><div class='ad'>buy</div><article><h1>H</h1><p><b>bold text.<br><p>two<p>three &eacute;<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><form>f</form></article><footer>z"
    assert H.main_text(html) == "H\nbold text.\ntwo\nthree é\na\nb\nc\nd"
    assert H.main_text("plain < words &amp; all") == "plain < words & all"
    assert H.main_text("<p>x <!-- never closed <p>y</p>") == "x"
    assert H.main_text("<article>a<script>b</article>") == "a"
    for bad in ("", None, "<", "<a", "</", "<article>", "<!--", "<div class=\"x", "&", "<p title='>"):
        H.main_text(bad)
    assert H.main_text("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after") == "deep\nafter"
    assert H.main_text("<span>" * 3000 + "deep") == "deep" and H.main_text("<li><p>" * 3000) == ""


def test_copies_do_not_become_template():
    same = [page(1, "<p>one and the same article on every page of the host</p>")] * 6
    assert H.induce(same) is None
    mixed = same + [page(k, f"<p>another article number {k} stands here</p>") for k in (2, 3)]
    wrapper = H.Wrapper.load(H.induce(mixed))
    assert H.main_text(same[0], wrapper) == "one and the same article on every page of the host"


def test_matching_is_order_preserving():
    a, b = H.page_runs("<div><p>1</p><ul><li>2</ul><h2>3</h2></div>"), H.page_runs("<div><h2>x</h2><p>1</p><h2>3</h2></div>")
    total, pairs = H.matching(a.children, b.children, {})
    assert total == 3 and pairs == [(0, 0)]


def test_query(spark):
    pages = [(k, f"http://h.example/{k}", page(k, f"<p>Words of page {k} that vary from page to page.</p>")) for k in range(30)]
    rows = [*pages, (100, None, "<p>no url</p>"), (101, "http://lone.example", page(5, "<p>lone page with words that are long</p>")), (102, "http://h.example/", None), (3, *pages[3][1:]), (None, "nonsense", "<p>q</p>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = H.extract(df).collect()
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    assert len(got) == len(rows) and len(by[3]) == 2 and by[3][0]["text"] == by[3][1]["text"]
    assert all(by[k][0]["text"] == f"Words of page {k} that vary from page to page." and by[k][0]["by_wrapper"] for k in range(30))
    assert by[100][0]["text"] == "no url" and by[102][0]["text"] == "" and by[None][0]["text"] == "q"
    # a lone page has no other page to tell its notices by
    assert by[101][0]["text"] == "hi\nSame notice on all pages.\nlone page with words that are long"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert H.extract(df.limit(0)).count() == 0


def test_shared_sentences_of_articles_stay():
    shared = "The same sentence is a part of all three articles."
    for tag in ("article", "main"):
        pages = [f"<html><body><nav><a>m</a></nav><{tag}><div><p>{shared}</p><p>Words of page {k} that stand on no other page.</p></div></{tag}></body></html>" for k in range(3)]
        wrapper = H.Wrapper.load(H.induce(pages))
        assert H.main_text(pages[1], wrapper) == f"{shared}\nWords of page 1 that stand on no other page."


CLASSES = "search-results share-price related-work notice navy widget-theory reply social-history sponsor".split()


def wild(k, tag="div class='c1'"):
    """A page without article or main, its classes meaningless; adverts and a constant notice inside the content too."""
    own = "".join(f"<div class='{c}'>Block {c} of page {k} is part of the text.</div>" for c in CLASSES)
    return (
        f"<html><body><div class='c7'><a href=1>Menu{k}</a> <a href=2>Other{k}</a></div><div class='c3'>Short margin words {k}</div>"
        f"<{tag} id='p{k}'><div class='c9'>We value your privacy.</div><h1>Title {k}</h1><p>Long first paragraph of page {k}, with words enough to matter to anyone who reads it.</p>"
        f"<p>This article was first printed in the Gazette.</p><div class='c3'>Inner margin words {k}</div>{own}<div class='comments'><p>reader {k}</p></div><form>f</form></{tag.split()[0]}><div class='c8'>Bottom {k}</div></body></html>"
    )


def wanted(k):
    own = [f"Block {c} of page {k} is part of the text." for c in CLASSES]
    return "\n".join([f"Title {k}", f"Long first paragraph of page {k}, with words enough to matter to anyone who reads it.", "This article was first printed in the Gazette.", *own])


def test_region_by_varying_slots_without_article_or_telling_classes():
    for tag in ("div class='c1'", "div class='post-%d'", "article", "section"):
        pages = [wild(k, tag % k if "%" in tag else tag) for k in range(6)]
        wrapper = H.Wrapper.load(H.induce(pages[:5]))
        assert all(H.main_text(p, wrapper) == wanted(k) for k, p in enumerate(pages)), tag
        # without the wrapper neither the constant notice nor the margin's kind of block is known
        alone = H.main_text(pages[5])
        assert alone != wanted(5) and "We value your privacy." in alone and "Inner margin words 5" in alone


def test_headings_beside_the_fullest_child_stay():
    pages = [f"<body><div><h1>Head {k}</h1><section><p>{'words of page %d ' % k * 20}</p></section></div></body>" for k in range(4)]
    wrapper = H.Wrapper.load(H.induce(pages))
    assert all(H.main_text(p, wrapper).startswith(f"Head {k}\nwords of page {k}") for k, p in enumerate(pages))


def test_two_layouts_of_a_host():
    one = [wild(k) for k in range(4)]
    two = [f"<html><body><main><h1>M {k}</h1><p>other layout, page {k}</p></main></body></html>" for k in range(2)]
    wrapper = H.Wrapper.load(H.induce(one + two))
    assert H.main_text(one[0], wrapper) == wanted(0) and H.main_text(two[1], wrapper) == "M 1\nother layout, page 1"
