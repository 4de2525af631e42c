"""Operator 6 aligns lists of every length, and weighs whole subtrees, as plain simple tree matching does."""

import random
from functools import cache

from folioframe.llm import html_text as H


def brute_weight(a, b):
    @cache
    def weight(i, j):
        if a.nodes[i][1] != b.nodes[j][1]:
            return 0
        x, y = a.children[i], b.children[j]
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for p, u in enumerate(x):
            for q, v in enumerate(y):
                best[p + 1][q + 1] = max(best[p][q + 1], best[p + 1][q], best[p][q] + weight(u, v))
        return 1 + best[-1][-1]

    return weight(0, 0)


def tree(r, depth=0):
    inner = "".join(tree(r, depth + 1) if depth < 4 and r.random() < 0.4 else f"<{t}>w</{t}>" for t in r.choices(["p", "h2", "li", "td"], k=r.randint(0, 6 if depth else 25)))
    tag = r.choice(["div", "section"])
    return f"<{tag}>{inner}</{tag}>"


def test_as_many_nodes_as_a_best_matching():
    r = random.Random(5)
    for _ in range(60):
        a, b = (H.Tree(H.parse("<body>" + tree(r) + "</body>")) for _ in range(2))
        pairs = H.matched(a, b)
        assert len(pairs) == brute_weight(a, b)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)


def test_partner_far_down_a_long_list():
    a = H.Tree(H.parse("<h2>same</h2>" + "<p>a</p>" * 20 + "<pre>x</pre>"))
    b = H.Tree(H.parse("<li>b</li>" * 30 + "<h2>same</h2>" + "<p>b</p>" * 20 + "<dt>y</dt>"))
    assert any(a.nodes[i][3] == b.nodes[j][3] == "same" for i, j in H.matched(a, b))


def test_deep_pages():
    a, b = (H.Tree(H.parse("<div>" * 1500 + x)) for x in ("<p>a</p>", "<p>a</p><h2>b</h2>"))
    assert len(H.matched(a, b)) == 1502


def test_parts_of_names_say_nothing(spark):
    from folioframe.llm import html_text

    p = lambda t: f"<p>{t} " + "words of a paragraph that is long enough to be read " * 3 + "</p>"
    bodies = {
        1: (f"<div class='side-effects'>{p('one')}</div>", "one"),
        2: (f"<div id='header-image'>{p('two')}</div>", "two"),
        3: (f"<div class='search-results'>{p('three')}</div>", "three"),
        4: (f"<form id='aspnetForm'><article>{p('four')}</article><div class='site-footer'>{p('foot')}</div></form>", "four"),
        5: (f"<form><h1>Heading</h1><div>{p('five')}</div></form>", "Heading"),
        6: (f"<div class='wide main-menu'>{p('menu')}</div><div>{p('six')}</div><form><p>Name</p></form>", "six"),
    }
    rows = [(i, f"http://h{i}.example/", f"<html><body>{b}</body></html>") for i, (b, _) in bodies.items()]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, (_, begins) in bodies.items():
        assert got[i].startswith(begins) and not {"foot words", "menu words", "Name"} & set(got[i].split("\n")), got[i]
        assert got[i].count("paragraph") == 3
