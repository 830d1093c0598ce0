"""Layout-aware rendering of fixed pages, and words in order on random markup."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlens.llm.html import extract, render

CASES = [
    ("<p>one<p>two<br>three", "one\n\ntwo\nthree"),
    ("a &amp; b&nbsp;c &lt;d&gt; &#233;", "a & b\xa0c <d> é"),
    ("  a\n\n b <b> c</b>d ", "a b cd"),
    ("<div>a<div>b</div>c</div>d", "a\nb\nc\nd"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
    ("<li>loose", "loose"),
    ("<h1>t</h1><p>a</p><hr>b", "t\n\na\n\nb"),
    ("<dl><dt>t<dd>d one<dd>d two</dl>", "t\n  d one\n  d two"),
    ("<pre>\n a\n  b\t|</pre>c", " a\n  b     |\n\nc"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("<table><tr><th>Name<th>N<tr><td>long cell<td>1<tr><td colspan=2>wider than both</table>",
     "Name       N\nlong cell  1\nwider than both"),
    ("<table><tr><td rowspan=2>r<td>2<tr><td>3<tr><td>x<td>y</table>", "r  2\n   3\nx  y"),
    ("<table><caption>c</caption><tr><td>a<br>b<td>1</table>", "c\na  1\nb"),
    ("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>", "in  ner  out"),
    ("<head><title>no</title><style>no</style></head><body>yes<script>var a='</p>no'</script></body>", "yes"),
    ("<p hidden>no</p><p style='color:red; Display : none'>no</p><div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>",
     "yes"),
    ("a<!-- no <p> -->b<!-- no", "ab"),
    ("<noscript>no</noscript><template>no</template><dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("<select><option>a<option>b</select> <button>go</button>", "a b go"),
    ("1 < 2 > 1 <notatag", "1 < 2 > 1 <notatag"),
    ("<a title='x > y' href=\"q\">link</a></b></div>end", "linkend"),
    ("<p>a<span>b<p>c</span>d", "ab\n\ncd"),
    ("<textarea> raw <b>\n x</textarea>", " raw <b>\n x"),
    ("<b>" * 160 + "<div hidden>secret</div>visible", "visible"),
    ("<div>" * 400 + "<ul><li>a" + "<span>" * 400 + "<li>b</ul><table><tr><td>x<td>y", "- a\n- b\n\nx  y"),
    ("<input value=a><input type=email value=b><input type=password value=no><input type=Search value=c><input type=hidden value=no>"
     "<input type=date value=d><input type=checkbox value=no><input type=unknown value=e>", "a b c d e"),
    ("", ""),
    (None, None),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_pages(page, text):
    assert render(page) == text


TAGS = st.sampled_from("p div ul ol li table tr td th b br hr pre blockquote dl dt dd h1 select option tbody span a".split())
PIECES = st.one_of(TAGS.map(lambda t: f"<{t}>"), TAGS.map(lambda t: f"</{t}>"), st.just(" "),
                   st.sampled_from(["<td colspan=3>", "<td rowspan=2>", "<ol start=x>", "<!-- c -->", "<i", "<tr rowspan=0>"]),
                   st.integers(0, 99).map(lambda i: f" w{i} "))


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=60))
def test_no_word_is_lost(pieces):
    page = re.sub(r"<i(?=[^>]*<)", "", "".join(pieces)).replace("<i", "")
    want = re.findall(r" (w\d+) ", re.sub("<[^>]*>", " ", page).replace("  ", " ").replace(" ", "  "))
    got = re.findall(r"w\d+", render(page))
    assert sorted(got) == sorted(want)
    if "<t" not in page and "</t" not in page:
        assert got == want


INLINE, DIVS, SPACED = ("b", "span", "i", "a"), ("div", "section", "address"), ("p", "h2", "blockquote", "pre")
NAMES = st.sampled_from([*INLINE, *DIVS, *SPACED, "ul", "ol"])
LEAF = st.integers(0, 999).map(lambda i: f"w{i}")
HIDE = st.sampled_from(["", "", "", "", " hidden", " style='display:none'"])
TREE = st.recursive(LEAF, lambda inner: st.tuples(NAMES, HIDE, st.lists(inner, max_size=4)), max_leaves=25)


def markup(tree):
    if isinstance(tree, str):
        return f" {tree} "
    name, hide, inside = tree
    if name in ("ul", "ol"):
        return f"<{name}{hide}>" + "".join(f"<li>{markup(t)}</li>" for t in inside) + f"</{name}>"
    return f"<{name}{hide}>" + "".join(map(markup, inside)) + f"</{name}>"


def plain(trees, item=False):
    """Lines of a tree by a plain recursion over what each element adds: words to a line, or a block with its gap."""
    lines, line, due = [], [], False

    def put(block, gap, after=None):
        nonlocal line, due
        if line:
            put_words = " ".join(line)
            line = []
            put([put_words], False)
        due = due or gap
        if block:
            if due and lines:
                lines.append("")
            due = False
            lines.extend(block)
        due = due or (gap if after is None else after)

    def walk(tree, parent):
        nonlocal line
        if isinstance(tree, str):
            line.append(tree)
            return
        name, hide, inside = tree
        if hide:
            return
        if name in INLINE:
            for t in inside:
                walk(t, name)
        elif name in ("ul", "ol"):
            out, n = [], 0
            for t in inside:
                n += 1
                mark = f"{n}. " if name == "ol" else "- "
                got = plain([t], True)
                out += [(mark if k == 0 else " " * len(mark)) + x if x else x for k, x in enumerate(got)]
            put(out, parent != "li")
        elif name == "blockquote":
            put(["  " + x if x else x for x in plain(inside)], True)
        else:
            put([], name in SPACED)
            for t in inside:
                walk(t, name)
            put([], name in SPACED)

    for t in trees:
        walk(t, "li" if item else "")
    put([], False)
    return lines


@settings(max_examples=500, deadline=None)
@given(st.lists(TREE, max_size=5))
def test_trees_equal_plain_recursion(trees):
    """Trees without a paragraph around blocks or a preformatted element, which have rules of their own."""
    def legal(tree, banned=()):
        if isinstance(tree, str):
            return tree
        name, hide, inside = tree
        if name in banned or name == "pre":
            name = "b"
        inner = tuple({*banned, *(DIVS + SPACED + ("ul", "ol"))}) if name in ("p",) else banned
        return name, hide, [legal(t, inner) for t in inside]

    trees = [legal(t) for t in trees]
    assert render("".join(map(markup, trees))) == "\n".join(plain(trees))


def test_hostile_markup():
    for page in ("<a <" * 20_000, "<a \"" * 20_000, "<div>" * 20_000 + "x", "<" * 50_000, "<table>" * 2000 + "x", "<p>" * 20_000,
                 "<p><button>" + "<div>" * 20_000, "<ul><li>" * 1000 + "x", "<td>" * 20_000, "<dl><dd>" * 1000, "</b>" * 20_000):
        render(page)
    assert render("<b>" * 1000 + "x" + "</b>" * 1000 + "y") == "xy"


def test_frame(spark):
    rows = [(1, "<p>a", "old", "u"), (None, None, None, None), (1, "<p>a", "old", None), (3, "x" * 300_000, "", "")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, url string")
    got = extract(df).collect()
    assert sorted((str(r.page_id), str(r.text)[:3]) for r in got) == [("1", "a"), ("1", "a"), ("3", "xxx"), ("None", "Non")]
    assert extract(df.limit(0)).count() == 0
