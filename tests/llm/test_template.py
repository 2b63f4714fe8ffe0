"""Template deduction against brute force on sequences of tokens."""

import random

from talkweave.llm import media, template


def template_by_hand(pages):
    """Tokens of the template of one site's distinct pages (lists of tokens), from the definitions."""
    n = len(pages)
    if n < template.MIN_PAGES:
        return set()
    by_vector = {}
    for t in {t for p in pages for t in p}:
        by_vector.setdefault(tuple(p.count(t) for p in pages), set()).add(t)
    groups = []
    for vector, tokens in by_vector.items():
        on = sum(x > 0 for x in vector)
        if len(tokens) >= template.MIN_TOKENS and on >= min(template.ALL_PAGES, n) and on >= template.MIN_SHARE * n:
            groups.append(tokens)

    def rounds(page, tokens):
        at = [k for k, t in enumerate(page) if t in tokens]
        return [at[k : k + len(tokens)] for k in range(0, len(at), len(tokens))]

    def ordered(tokens):
        return len({tuple(page[k] for k in r) for page in pages for r in rounds(page, tokens)}) <= 1

    def cross(a, b):
        for page in pages:
            for x in rounds(page, a):
                for y in rounds(page, b):
                    if any(x[0] < y[0] < k < y[-1] for k in x) or any(y[0] < x[0] < k < x[-1] for k in y):
                        return True
        return False

    left = [g for g in groups if ordered(g)]
    return left, cross


def site(rng):
    """Pages of a random template: fixed parts, loops of rows and optional parts, filled with tokens of their own; sometimes out of order or crossing."""
    fresh = iter(range(10**6, 10**9, rng.randint(1, 99)))
    head, row, foot, stray = ([rng.randrange(1, 10**6) for _ in range(rng.randint(3, 5))] for _ in range(4))
    kind = rng.choice(["nested", "crossing", "shuffled"])
    pages = []
    for _ in range(rng.randint(3, 12)):
        page = []
        for t in head:
            page += [t] + [next(fresh) for _ in range(rng.randint(0, 2))]
        for _ in range(rng.randint(0, 4)):
            for t in row:
                page += [t, next(fresh)]
        extra = list(foot)
        if kind == "shuffled" and rng.random() < 0.5:
            rng.shuffle(extra)
        page += extra
        if rng.random() < 0.8:  # a part of its own vector, that may begin inside another
            at = len(page) - len(foot) if kind == "nested" else len(page) - 2
            page[at:at] = stray[:2] if kind == "crossing" else stray
            page += stray[2:] if kind == "crossing" else []
        pages.append(page)
    return pages


def test_templates(spark):
    rng = random.Random(2)
    sites = {f"s{k}": site(rng) for k in range(120)}
    rows = [(s, k, p) for s, pages in sites.items() for k, p in enumerate(pages)]
    rows += [(s, k, p) for s, k, p in rows if k % 3 == 0]  # copies count once
    got = {r.site: set(r.template) for r in template.templates(spark.createDataFrame(rows, "site string, digest long, tokens array<long>")).collect()}
    some = crossed = 0
    for s, pages in sites.items():
        if len(pages) < template.MIN_PAGES:
            assert s not in got
            continue
        groups, cross = template_by_hand(pages)
        found = got.get(s, set())
        kept = [g for g in groups if g <= found]
        assert found == set().union(*kept)
        # what is kept is nested, and what isn't crosses a kept class that is as large or larger
        assert not any(cross(a, b) for a in kept for b in kept if a is not b)
        assert all(any(cross(a, b) and len(b) >= len(a) for b in kept) for a in groups if a not in kept)
        some += bool(kept)
        crossed += len(kept) < len(groups)
    assert some > 60 and crossed > 5


def test_slots():
    blocks = [{"at": k} for k in (0, 2, 3, 6)]
    assert template.slots_of([9, 1, 8, 7, 2, 3, 6], {1, 2}, blocks) == [0, 1, 1, 2]


def test_pages_without_names(spark):
    """Nothing but div and p, no names: only what repeats on the site tells the frame from the text."""
    frame = "<div><p>Best prices</p><p>Home</p><p>Contact us</p></div><div><p>%s</p></div><div><p>All rights reserved</p></div>"
    rows = [(i, f"http://plain.example/{i}", frame % f"Story {i}</p><p>ends {i * 7}") for i in range(6)]
    # a column of fresh headlines and a class name on some pages only: the slot's majority decides
    side = '<nav><p>%s</p></nav><section class="%s"><p>%s</p></section><p>x</p>'
    rows += [(20 + i, f"http://odd.example/{i}", side % (f"Headline {i}", "related" if i == 3 else "", f"Body {i}")) for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    on = {r.page_id: r.text for r in template.main_text(pages).collect()}
    off = {r.page_id: r.text for r in template.main_text(pages, 1 << 40).collect()}
    assert [on[i] for i in range(6)] == [f"Story {i} ends {i * 7}" for i in range(6)]
    assert all(off[i] != on[i] for i in range(6))
    assert on[21] == "Body 1"
    assert template.main_text(pages.where("false")).count() == 0


def page_text(source):
    blocks = [dict(zip(("at", "token", "text", "article", "region"), b, strict=True)) for b in template.Page(source).blocks]
    return " ".join(template.chosen([], blocks, None, None))


def test_nothing_of_the_text_is_lost(spark):
    """An outer form, a wrapper with a listed name, a teaser article, headings that all articles share, and names inside an article."""
    words = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    menu = '<nav><a href="/">Home</a></nav>'
    layouts = {
        "form": ('<body><form id="aspnetForm">' + menu + "<div><h1>{0}</h1><p>{1}</p></div></form></body>", "{0} {1}"),
        "widget": ("<body>" + menu + '<div class="widget"><p>{0}</p><p>{1}</p></div></body>', "{0} {1}"),
        "teaser": ("<body>" + menu + '<article>one two three four five six seven eight</article><div class="content"><p>{0}</p><p>{1}</p></div></body>', None),
        "headings": ("<body>" + menu + "<article><h2>Introduction</h2><p>{0}</p><h2>Methods</h2><p>{1}</p></article></body>", "Introduction {0} Methods {1}"),
        "parts": ("<body>" + menu + '<article><p id="ad">{0}</p><math><mi>x</mi></math><div class="social">{1}</div></article></body>', "{0} x {1}"),
        "comments": ("<body>" + menu + '<div><p>{0}</p></div><div class="comments">{1} {1} {1}</div></body>', "{0}"),
    }
    rows, expected = [], []
    for h, (source, text) in enumerate(layouts.values()):
        for i in range(6):
            parts = words(10 * h + i, 9), words(1000 + 10 * h + i, 40)
            rows.append((100 * h + i, f"http://h{h}.example/{i}", source.format(*parts)))
            expected.append((text or "{0} {1}").format(*parts))
    got = {r.page_id: r.text for r in template.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for (i, _, source), text in zip(rows, expected, strict=True):
        assert got[i].endswith(text) and len(got[i]) <= len(text) + 50, (i, got[i], text)
        assert text in page_text(source)


def test_broken_markup_takes_linear_time():
    import time

    deep = "<div><b>" * 20_000
    for source in ("<a " * 350_000, '<a x="' * 170_000, "<a x='\"" * 120_000 + ">", '<a x="> ' * 120_000, deep + "</i>" * 200_000, deep + "<p>x" * 50_000, "<nav>x" * 60_000, "<b>x" * 100_000, "<!--" * 250_000, "<script>" * 100_000, "<span>" * 50_000 + "<li>" * 50_000, "<q " + "a " * 300_000):
        began = time.process_time()
        template.Page(source)
        assert time.process_time() - began < 4, source[:20]
        began = time.process_time()
        media.parts_of(source + "<img src=x><figure>" * 1000)
        assert time.process_time() - began < 4, source[:20]


def test_tags_in_quotes_and_without_end():
    assert page_text('<p title="a > b">text</p> <p class=\'x\' id="y\'>">more</p>') == "text more"
    assert page_text('<p>one<p title="never ended>two<p>three') == "one two three"
    assert page_text("<p>a < b and a<b") == "a < b and a<b"
    assert page_text("<p>kept<!-- gone") == "kept"


def test_templates_decide(spark):
    """Made-up sites whose pages name nothing: with the template the frame goes, without it everything stays."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n))
    rows, expected = [], {}
    for h in range(20):
        top, bottom = [line(rng.randint(1, 4)) for _ in range(rng.randint(1, 5))], [line(rng.randint(2, 5)) for _ in range(rng.randint(1, 4))]
        outer, inner = rng.choice([("div", "p"), ("section", "div"), ("td", "p")]), rng.choice(["p", "div"])
        for i in range(rng.randint(4, 9)):
            story = [line(rng.randint(5, 40)) for _ in range(rng.randint(1, 6))]
            frame = lambda parts: f"<{outer[0]}>" + "".join(f"<{outer[1]}>{x}</{outer[1]}>" for x in parts) + f"</{outer[0]}>"  # noqa: B023, E731
            expected[100 * h + i] = " ".join(story)
            rows.append((100 * h + i, f"http://s{h}.example/{i}", f"<html><body>{frame(top)}<div>{''.join(f'<{inner}>{x}</{inner}>' for x in story)}</div>{frame(bottom)}</body></html>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    on = {r.page_id: r.text for r in template.main_text(pages).collect()}
    off = {r.page_id: r.text for r in template.main_text(pages, 1 << 40).collect()}
    assert on == expected and not any(off[i] == expected[i] for i in expected)
