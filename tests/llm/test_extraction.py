"""Wrappers by hand, and extraction against pages whose article is known."""

import html
import json
import random
import re

import pytest

from rankweave.llm import extraction
from rankweave.llm.common import prepare
from rankweave.llm.markup import Tags
from rankweave.llm.wrappers import Element, Rules, absorb, add_page, aligned, decide, expression, folded, merged

SCHEMA = "page_id long, url string, html string"


def infer(*pages):
    root = Element()
    for page in pages:
        add_page(root, page, Tags())
    return root


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij&<é", k=rng.randint(2, 9))) for _ in range(n))


def test_alignment_finds_slots_optionals_and_repeats():
    one = "<div><h2>Books of:</h2><b>John</b><ul><li><i>Title</i> A</li></ul></div>"
    two = "<div><h2>Books of:</h2><img><b>Paul</b><p>new</p><ul><li>B</li><li>C</li></ul></div>"
    assert expression(infer(one, two)) == "div(# h2(=) p(=)? ul(li(#)+))"


def test_alignment_groups_what_changes_order():
    assert folded([["h2"], ["p"], ["p"], ["h2"], ["p"], ["ul"]]) == [["h2", "p"], ["ul"]]
    assert aligned([["a"], ["c"]], [["a"], ["b"], ["c"]]) == [["a"], ["b"], ["c"]]
    assert aligned([["a"], ["b"], ["c"]], [["b"], ["a"], ["c"]]) == [["b", "a"], ["c"]]
    page = "<article><h2>x</h2><p>y</p><h2>z</h2><p>w</p></article><footer>f</footer>"
    assert expression(infer(page)) == "article((h2(#)+|p(#)+)+) footer(=)"


def test_order_of_alignment_changes_no_rule():
    rng = random.Random(5)
    pages = []
    for n in range(12):
        body = "".join(f"<p>{html.escape(words(rng, 8))}</p>" for _ in range(rng.randint(1, 4)))
        side = "<div class='promo'>Buy</div>" if n % 3 else ""
        head = f"<h1>{n}</h1>" if n % 2 else ""
        pages.append(f"<div class=top>Site</div>{side}<div class=c{'x' if n % 4 else ''}>{head}{body}</div>")
    dumps = [json.dumps(infer(p).dump()) for p in pages]
    want = decide(infer(*pages))
    for _ in range(5):
        rng.shuffle(dumps)
        left, right = merged(dumps[:5]), merged(dumps[5:])
        absorb(left, right)
        got = decide(left)
        assert {k: sorted(v) if isinstance(v, list) else v for k, v in got.items()} == {
            k: sorted(v) if isinstance(v, list) else v for k, v in want.items()
        }


def test_many_classes_are_generalised():
    page = lambda n: f"<div class='q{'abcdefghij'[n // 10]}{'klmnopqrst'[n % 10]}'><p>text {n}</p></div>"
    root = infer(*(page(n) for n in range(100)))
    assert root.plain and list(root.below) == ["div"] and root.below["div"].times == 100
    assert merged([json.dumps(infer(page(n)).dump()) for n in range(100)]).below["div"].times == 100


PARTS = {
    "semantic": "<header><a href=/>Site</a></header><nav><ul><li><a href=/x>{w}</a></ul></nav><article>{a}</article>"
    "<section id='comments'><article class=comment><p>{w}</article></section><footer>&copy; {w}</footer>",
    "classes": "<div class='site-header'>{w}</div><div id=main-menu><a href=x>{w}</a></div><div class='cookieNotice'>{w}</div>"
    "<div class='post-content'>{a}</div><div class=sidebar><p>{w}</p></div><form><p>{w}<input><button>Go</button></form>",
    "plain": "<div class=wrap><div class=x><span class=advert>{w}</span><ul><li><a href=1>{w}</a><li><a href=2>{w}</a></ul></div>"
    "<div class=y>{a}</div></div><div role=contentinfo>{w}</div>",
    "inside": "<main><article><header>{h}</header>{a}<div class='share'>{w}</div><aside>{w}</aside><div class=ad>{w}</div>"
    "<div class=z>Read this site every day</div></article></main>",
}


def planted(seed=11, each=12):
    """(url, html, text) of four hosts with one template each; paragraphs are left open, and odd references are used."""
    rng = random.Random(seed)
    for name, template in PARTS.items():
        for n in range(each):
            blocks, out = [], []
            for k in range(rng.randint(2, 6)):
                text = words(rng, rng.randint(15, 40))
                tag = rng.choice(["p", "p", "h2", "li"]) if k else "h1"
                shown = html.escape(text).replace(" ", rng.choice([" ", "\n\t", " <b>", "&#32;", "<br>"]), 1)
                shown = f"<ul><li>{shown}</ul>" if tag == "li" else f"<{tag}>{shown}" + rng.choice(["", f"</{tag}>"] if tag == "p" else [f"</{tag}>"])
                blocks.append(" ".join(text.split()))
                out.append(shown + rng.choice(["", "<!-- <p>no</p> -->", "<script>var t='</p><p>x'</script>"]))
            said = words(rng, 5).replace("<", "")
            body = template.replace("{a}", "".join(out)).replace("{h}", f"<p>by {n}</p>")
            body = re.sub(r"\{w\}", lambda _: html.escape(words(rng, rng.randint(2, 4))), body)
            head = "" if n % 5 == 0 else f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{said}</title><style>p{{}}</style>"
            text = "\n\n".join(([f"by {n}"] if name == "inside" else []) + blocks)
            yield f"https://{name}.example/{n}", head + ("" if n % 7 == 0 else "</head><body>") + body, text


def found(spark, rows, clashes=False):
    prepare(spark)
    df = spark.createDataFrame(rows, SCHEMA)
    if clashes:
        for name in ("host", "rules", "text", "n_chars", "part", "group", "n"):
            df = df.selectExpr("*", f"'{name}' AS {name}")
    return [tuple(r) for r in extraction.extract(df).collect()]


@pytest.mark.parametrize("parts", [1, 40])
def test_planted_pages(spark, parts):
    prepare(spark)
    rows = list(planted())
    df = spark.createDataFrame([(n, u, h) for n, (u, h, _) in enumerate(rows)], SCHEMA).repartition(parts)
    got = {r.page_id: r for r in extraction.extract(df).collect()}
    assert len(got) == len(rows)
    wrong = [(u, got[n].text, t) for n, (u, _, t) in enumerate(rows) if got[n].text != t]
    assert not wrong, (len(wrong), wrong[0])
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_supplied_pages(spark, folder):
    """Every page against its article cut out by its tags."""
    prepare(spark)
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    got = {r.page_id: r for r in extraction.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for row in rows:
        article = re.search(r"<article>(.*?)</article>", row.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[row.page_id].text == "\n\n".join(b for b in blocks if b) and got[row.page_id].url == row.url


def test_edges(spark):
    long = "<p>" + "word " * 200_000 + "</p>"
    deep = "<div>" * 3000 + "deep text of a page" + "</div>" * 2999
    rows = [
        (1, "http://a.b/1", None), (2, "http://a.b/2", ""), (3, None, "<article><p>One &amp; two&nbsp;&#x41;</article>"),
        (3, None, "<article><p>One &amp; two&nbsp;&#x41;</article>"), (None, "odd", "just text"), (5, "http://c/", long),
        (6, "http://d/", deep), (7, "http://e/", "<article>a < b &amp;amp; c <p title='x>y' class=\"z>\">d</p><p"),
        (8, "http://f/", "<nav>only a menu</nav><script>x"), (9, "http://g/", "</div></p><p>a</ul><b>b<p>c</b>d<td>e"),
    ]
    want = {
        (1, ""), (2, ""), (3, "One & two A"), (None, "just text"), (5, ("word " * 200_000).strip()),
        (6, "deep text of a page"), (7, "a < b &amp; c\n\nd"), (8, ""), (9, "ab\n\ncd\n\ne"),
    }
    for clashes in (False, True):
        got = found(spark, rows, clashes)
        assert len(got) == len(rows) and {(r[0], r[2]) for r in got} == want
    assert found(spark, []) == []


def test_wrappers_of_hosts(spark):
    prepare(spark)
    df = spark.createDataFrame([(n, u, h) for n, (u, h, _) in enumerate(planted())], SCHEMA).repartition(20)
    held = {r.host: r for r in extraction.infer_wrappers(df).collect()}
    assert {h: r.n_pages for h, r in held.items()} == {f"{p}.example": 12 for p in PARTS}
    assert "/article" in json.loads(held["semantic.example"].rules)["first"]
    assert "/div.wrap/div.y" not in json.loads(held["plain.example"].rules)["first"]
