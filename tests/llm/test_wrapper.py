from causeway.llm import wrapper
from causeway.llm.wrapper import Slot, extract, learn, main_text, matching, page_tree


def page(k, body):
    return f"<html><head><title>T{k}</title><style>p{{x}}</style><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href='/'>Home {k}</a></ul></nav>{body}<footer>&copy; site {k}</footer></body></html>"


def test_article_without_boilerplate():
    text = page(1, "<header>Site head</header><!-- c --><div class='ad-box'>Buy</div><article><h1>Title &amp; more</h1><p>One\n  two<b>three</b> four.<br>Five<p>Six &lt;tag&gt; &eacute;&#x20;end<aside>side</aside><form>mail <input></form><div id='comments'>first!</div><footer>by me</footer></article>")
    assert main_text(text) == "Title & more One twothree four. Five Six <tag> é end"


def test_template_of_a_host():
    pages = [page(k, f"<div class=wrap><p>Welcome to our pages.</p><p>Story {k} begins here and goes on for a while.</p><p>It ends with {k * k}.</p><p>All rights reserved.</p></div>") for k in range(6)]
    template = page_tree(pages[0])[0]
    for p in pages[1:]:
        learn(template, page_tree(p)[0])
    assert main_text(pages[3], Slot.load(template.dump())) == "Story 3 begins here and goes on for a while. It ends with 9."
    alone = main_text(pages[3])
    assert alone.startswith("Welcome to our pages. Story 3") and "site" not in alone and "Home" not in alone


def test_simple_tree_matching():
    a, b = Slot("r"), Slot("r")
    a.kids = [Slot("x"), Slot("y"), Slot("z")]
    b.kids = [Slot("y"), Slot("q"), Slot("z"), Slot("x")]
    assert matching(a, b, {}) == (3, [(1, 0), (2, 2)])


def test_any_text_is_parsed():
    for text in ("<", "<<<>>", "<a", "<p title='x>y", "</p></b>", "<article>", "<article><p>open <b>bold", "<script>never ends", "&amp &notanentity; &#0;", "<div>" * 5000 + "x", "a<b>" * 3000, "<!-- open", "<p>" + "w " * 200000):
        assert isinstance(main_text(text), str)
    assert main_text("<article><p>open <b>bold") == "open bold"
    assert main_text("<div>" * 5000 + "x") == "x"
    wide = "".join(f"<i class=c{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}>w</i><div class=d{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}>v{k}</div>" for k in range(400))
    t = page_tree(wide)[0]
    learn(t, page_tree(wide)[0])
    assert len(t.kids) <= wrapper.WIDE


def test_query(spark):
    rows = [(k, f"http://h{k % 3}.org/{k}", page(k, f"<article><p>Text {k}</p></article>")) for k in range(40)]
    rows += [(50, None, None), (51, "nonsense", ""), (52, "http://h0.org/x", "plain text"), (0, rows[0][1], rows[0][2]), (None, "http://u@H1.org:80/?q", rows[1][2])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, template string").repartition(4)
    got = extract(df).collect()
    assert len(got) == len(rows)
    texts = {r["page_id"]: r for r in got}
    assert all(texts[k]["text"] == f"Text {k}" and texts[k]["n_chars"] == len(f"Text {k}") for k in range(40))
    assert [texts[k]["text"] for k in (50, 51, 52, None)] == ["", "", "plain text", "Text 1"]
    assert extract(df.limit(0)).count() == 0
    assert wrapper.templates(df).count() == 3  # the page without markup has a host of the others


def test_constant_text_among_many_siblings(spark):
    notice = "Please read our terms before you go on."
    rows = [(k, f"http://many.org/{k}", page(k, "<article>" + "".join(f"<p>Part {j} of page {k}.</p>" for j in range(30)) + f"<p>{notice}</p></article>")) for k in range(40)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    assert len(got) == 40
    assert all(r["text"] == " ".join(f"Part {j} of page {r['page_id']}." for j in range(30)) for r in got)


def bare(site, k):
    """A page that names nothing: only its place on the pages of the host tells what is template."""
    more = "".join(f"<div><div>Item {site} {k} {j} of many</div></div>" for j in range(k % 4))
    body = f"<div>Story {site} {k} begins</div>{more}<div>and ends in year {1900 + k}</div>"
    return f"<div><div>Welcome to {site}</div><div>All rights with {site}</div><div>{body}</div><div>Call the office of {site}</div></div>"


def bare_text(site, k):
    return " ".join([f"Story {site} {k} begins", *(f"Item {site} {k} {j} of many" for j in range(k % 4)), f"and ends in year {1900 + k}"])


def test_templates_decide_where_pages_name_nothing(spark):
    rows = [(k, f"http://{site}.example/{k}", bare(site, k)) for site in ("north", "south") for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one = {r["url"]: r["text"] for r in wrapper.extract(df.repartition(1)).collect()}
    assert all(one[u] == bare_text(u[7:12], k) for k, u, _ in rows)
    # tags and names alone keep what all pages share
    assert not any(wrapper.main_text(h) == one[u] for _, u, h in rows)
    again = {r["url"]: r["text"] for r in wrapper.extract(df.orderBy(df.page_id.desc()).repartition(7)).collect()}
    assert again == one
    trees = [sorted(map(tuple, wrapper.shapes(d.select("url", "html")).collect())) for d in (df.repartition(1), df.repartition(6))]
    assert trees[0] == trees[1]
