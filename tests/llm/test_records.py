"""HTML, WARC, chat and vectors on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import ann, chat, html_extract, warc

PAGES = {
    "plain": ("<html><body><nav><a href='/'>Home</a></nav><article><h1>Title &amp; more</h1><p>First  para,\n graph.<p>Second<br>line <b>bold<p>Third.</article><footer>&copy; x</footer>", "Title & more\nFirst para, graph.\nSecond line bold\nThird."),
    "aside": ("<body><div class='sidebar'><p>buy, buy, buy</p></div><main><p>Only this, here, now.</p><div id=comments><p>me, too, and more</p></div><form>name <input></form></main>", "Only this, here, now."),
    "script": ("<article><script>if (a<b) { '</p>' }</script><p>Text<!-- no <p> --> stays</p><style>p{}</style></article>", "Text stays"),
    "no article": ("<body><div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><div><p>" + "A long, long, long text. " * 6 + "</p><p>And, then, some more words follow.</p></div></body>", ("A long, long, long text. " * 6).strip() + "\nAnd, then, some more words follow."),
    "hidden": ("<article><p>Seen</p><p hidden>unseen</p><p style='display: none'>unseen</p><p aria-hidden=true>unseen</p></article>", "Seen"),
    "not tags": ("<article><p>1 < 2 & 3 > 2 &am &amp &nbsp; x</p></article>", "1 < 2 & 3 > 2 &am & x"),
    "text": ("just words", "just words"),
    "cut": ("<article><p>Cut off <a href='x", "Cut off"),
    "list": ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
    "header": ("<header><h1>Site</h1></header><article><header><h1>Head</h1></header><p>Body</p></article>", "Head\nBody"),
    "unclosed": ("<b>one <b>two<p>Three", "one two\nThree"),
    "blank": (" \n ", ""),
}


LONG = ("A long, long, long text. " * 18).strip()
PAGES |= {
    "named page": (f"<body><div class='page with-sidebar'><div class='post'><p>{LONG}</p><p>End.</p></div></div>", f"{LONG}\nEnd."),
    "named widget": (f"<div class='elementor-widget text'><p>{LONG}</p></div>", LONG),
    "exactly a widget": (f"<div class='widget'><p>{LONG}</p></div>", LONG),
    "no comments": (f"<div class='entry no-comments'><p>{LONG}</p></div>", LONG),
    "sections": (f"<article><p>{LONG}</p><section class='related-work'><p>Work</p></section><p class='social-science'>Science</p></article>", f"{LONG}\nWork\nScience"),
    "sources": (f"<article><p>{LONG}</p><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul></article>", f"{LONG}\none\ntwo\nthree"),
    "formula": ("<article><p>Be <math><mi>x</mi></math>, press <button>OK</button> and see <object data=x>a figure</object>.</p><button>Menu</button></article>", "Be x, press OK and see a figure."),
    "second article": (f"<article><p>{LONG}</p></article><article><p>Brief.</p></article>", f"{LONG}\nBrief."),
    "split reference": ("<article><p>a &am<b>p;</b> &lt;b></p></article>", "a &amp; <b>"),
    "whole page is a form": (f"<form><div><p>{LONG}</p></div><input></form>", LONG),
    "advert longer than the article": (f"<div class=ad>{LONG}</div><article><p>Short, and, sweet.</p></article>", "Short, and, sweet."),
    "comments longer than the article": (f"<article><p>{LONG}</p><div id=comments><p>{LONG * 3}</p></div></article>", LONG),
    "teaser article": (f"<main><div><p>{LONG}</p><p>{LONG}</p></div><article><p>Tease, a, bit.</p></article></main>", f"{LONG}\n{LONG}\nTease, a, bit."),
    "loose text": (f"<div><p>{LONG}</p></div>And a loose sentence beside it.<nav>x</nav>", f"{LONG}\nAnd a loose sentence beside it."),
    "menu without a name": (f"<body><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul><p>{LONG}</p>", LONG),
}

L = "This paragraph has, as articles do, a good hundred characters of running text, so that it is told from what stands around it by its length."
NAMES_OF_PARTS = "comment-section post-comments user-comments reader-comments comments-wrapper commentsWrapper comments sidebar-right left-sidebar ad-container adsbygoogle cookie-popup newsletter-signup social-share-bar related-content related".split()
PAGES |= {f"{name} in an article": (f"<article><p>{L}</p><div class='{name}'><p>{L}</p></div><p>{L}</p></article>", f"{L}\n{L}") for name in NAMES_OF_PARTS}
PAGES |= {f"{name} most of the page": (f"<article><p>{L}</p><div class='{name}'>{f'<p>{L}</p>' * 12}</div></article>", L) for name in NAMES_OF_PARTS}
PAGES |= {f"{name} without article": (f"<body><div class=content>{f'<p>{L}</p>' * 3}</div><div class='{name}'><p>{L}</p></div></body>", "\n".join([L] * 3)) for name in NAMES_OF_PARTS}
PAGES |= {
    "sections of many lengths": ("<body><div class=content>" + "".join(f"<section><h2>Part {n}.{i}</h2>{f'<p>{L}</p>' * n}</section>" for i, n in enumerate((8, 1, 6, 1))) + "</div><ul><li><a href=1>x</a></ul></body>", "\n".join("\n".join([f"Part {n}.{i}"] + [L] * n) for i, n in enumerate((8, 1, 6, 1)))),
    "short closing section": (f"<div class=content><section>{f'<p>{L}</p>' * 4}</section><section><p>So it ends.</p></section></div>", "\n".join([L] * 4 + ["So it ends."])),
    "lead and title beside the body": (f"<body><div><h1>Title</h1></div><div><p>{L}</p></div><div>{f'<p>{L}</p>' * 9}</div></body>", "\n".join(["Title"] + [L] * 10)),
    "words of parts in an article": (f"<article><p>{L}</p><p class='notice'>Notice.</p><ul><li class='share'>A share.</li></ul><p class=ad>Buy.</p></article>", f"{L}\nNotice.\nA share."),
    "named teaser": (f"<article><p>{L}</p></article><article class='teaser'><p>{L}</p></article>", L),
    "named teaser inside": (f"<article><p>{L}</p><p>{L}</p><article class='teaser'><p>{L}</p></article></article>", f"{L}\n{L}"),
    "linked heading": (f"<article><p>{L}</p></article><article><h2><a href=x>More</a></h2><p>{L}</p></article>", L),
    "comments as articles": (f"<article><p>{L}</p></article><div id=comments><article class=comment><p>{L}</p></article></div>", L),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    html, want = PAGES[name]
    assert html_extract.main_text(html) == want


def test_extract_table(spark):
    rows = [(i, f"u{i}", h) for i, (h, _) in enumerate(PAGES.values())] + [(50, None, None), (51, "u", ""), (52, "x", "<p>" + "y " * 200_000), (52, "x", "<b" * 3000)]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert [got[i] for i in range(len(PAGES))] == [w for _, w in PAGES.values()] and got[50] == got[51] == ""
    assert html_extract.extract(pages.where("false")).count() == 0


def random_page(rng):
    """A page of nested elements with prose, links, named parts and articles, as nested tuples (tag, attributes, children)."""

    def text(n):
        return " ".join(rng.choice(["word", "and, so", "on", "of", "place.", "time"]) for _ in range(n))

    def node(depth, inside):
        kind = rng.choice(["p", "p", "p", "links", "div", "div", "section", "article", "h2", "nav", "form"] if depth < 4 else ["p", "links", "h2"])
        if kind == "p":
            return ("p", "", [text(rng.randint(1, 60))])
        if kind == "h2":
            return ("h2", "", [text(3)])
        if kind == "links":
            return (rng.choice(["ul", "div"]), "", [("a", " href=x", [text(1)]) for _ in range(rng.randint(1, 4))])
        tag = kind if kind != "article" or not inside else "section"
        name = rng.choice(["", "", "", " class='ad'", " class='ad-like page'", " id=comments", " id=readerComments", " class='sidebar-right x'"]) if tag in ("div", "section") else ""
        return (tag, name, [node(depth + 1, inside or tag == "article") for _ in range(rng.randint(1, 4))])

    return ("body", "", [node(0, False) for _ in range(rng.randint(1, 5))])


def html_of(n):
    return n if isinstance(n, str) else f"<{n[0]}{n[1]}>{''.join(map(html_of, n[2]))}</{n[0]}>"


def slow_main_text(page):
    """The rules of html_extract restated by recursion over a well-formed page of random_page()."""
    gone, blocks = set(), html_extract.BLOCK
    kids = lambda n: [c for c in n[2] if isinstance(c, str) or id(c) not in gone]
    size = lambda n: len(n.strip()) if isinstance(n, str) else sum(map(size, kids(n)))
    linked = lambda n: 0 if isinstance(n, str) else size(n) if n[0] == "a" else sum(map(linked, kids(n)))
    commas = lambda n: n.count(",") if isinstance(n, str) else sum(map(commas, kids(n)))
    own = lambda n: size(n) - linked(n)
    said = lambda n: "omments" in n[1]
    named = lambda n: "ad'" in n[1] or "sidebar" in n[1] or said(n)

    def walk(n, up=()):
        if not isinstance(n, str) and id(n) not in gone:
            yield n, up
            for c in n[2]:
                yield from walk(c, (n, *up))

    gone |= {id(n) for n, _ in walk(page) if n[0] == "nav"}
    total = own(page)
    clear = [(own(n), any(a[0] == "article" for a in up)) for n, up in walk(page) if n[0] == "p" and not any(named(a) or a[0] == "form" for a in up)]
    prose, inside = sum(c for c, _ in clear) >= 80, sum(c for c, a in clear if a) >= 80
    holds = lambda n: any(c[0] == "article" for c, _ in walk(n) if c is not n)

    def cut(n):
        if said(n):
            return prose or own(n) < 0.9 * total or not own(n)
        return (n[0] == "form" or named(n)) and (own(n) < 0.4 * total or not own(n) or (named(n) and inside and not holds(n)))

    gone |= {id(n) for n, _ in [*walk(page)] if cut(n)}
    last = lambda n: n.strip() if isinstance(n, str) else next((t for c in reversed(kids(n)) if (t := last(c))), "")
    points = {}
    for n, up in walk(page):
        if n[0] == "p" and size(n):
            base = (min(1, size(n) / 25) + commas(n) + min(size(n) / 100, 30)) * (1 - linked(n) / size(n))
            for level, a in enumerate([a for a in up if a[0] in blocks] + ["root"]):
                share = [1, 0.5][level] if level < 2 else 1 / (3 * level)
                points[id(a)] = points.get(id(a), 0) + base * (1 if a[0] == "article" else share)
    for n, _ in walk(page):
        if id(n) in points:
            points[id(n)] = (points[id(n)] + 25 * (n[0] == "article" and points[id(n)] > 0)) * (0.2 if named(n) else 1)
    score = lambda n: points.get(id(n), 0) * (own(n) / size(n)) if size(n) else 0
    scored = [(n, up) for n, up in walk(page) if points.get(id(n))]
    best, up = max(scored, key=lambda x: score(x[0]), default=(page, ()))
    root = (points.get(id("root"), 0)) * (own(page) / size(page)) if size(page) else 0
    keep = [page]
    full = lambda n: sum((min(1, size(p) / 25) + commas(p) + min(size(p) / 100, 30)) * (1 - linked(p) / size(p)) for p, _ in walk(n) if p[0] == "p" and size(p))
    if scored and root < score(best) and best[0] != "article":
        while up and up[0] is not page and up[0][0] != "form" and not named(up[0]) and full(up[0]) >= 1.25 * full(best) - 1e-9 and linked(up[0]) < 0.3 * size(up[0]):
            best, up = up[0], up[1:]
        root = -1
    if scored and root < score(best) and up:
        keep = []
        for c in up[0][2]:
            if c is best:
                keep.append(c)
            elif id(c) not in gone and c[0] != "form" and not named(c) and size(c):
                density = linked(c) / size(c)
                if best[0] == "article":
                    wanted = c[0] == "article" and density < 0.5  # headings of random pages are no links
                else:
                    reads = c[0] in blocks and density < 0.25 and (size(c) > 80 or last(c).endswith("."))
                    wanted = score(c) >= max(10, 0.2 * score(best)) or reads or (density < 0.5 and any(h[0] == "h2" for h, _ in walk(c)))
                keep += [c] if wanted else []
    lines = []

    def write(n, top):
        if isinstance(n, str):
            lines[-1] += n
        elif id(n) not in gone and not (top and n[0] in ("ul", "div") and size(n) and linked(n) >= 0.8 * size(n) and sum(x[0] == "a" for x, _ in walk(n)) >= 3):
            block = n[0] in blocks
            lines.extend([""] * block)
            for c in n[2]:
                write(c, n is page)
            lines.extend([""] * block)

    for k in keep:
        lines.append("")
        write(k, up[:1] == (page,) if k is not page else False)
    return "\n".join(" ".join(x.split()) for x in lines if x.strip())


def test_main_text_against_brute_force():
    rng = random.Random(12)
    kept = 0
    for _ in range(400):
        page = random_page(rng)
        got = html_extract.main_text(html_of(page))
        assert got == slow_main_text(page), html_of(page)
        kept += bool(got)
    assert kept > 300


def test_extract_whole_articles_among_other_parts():
    """Whatever stands around and inside it, all blocks of an article come out, and nothing else."""
    rng = random.Random(13)
    parts = ["<nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav>", "<div class='ad'>Buy, now, all of it.</div>", "<footer>&copy; us</footer>", "<aside><p>More, on, the side.</p></aside>", "<div id='comments'><p>Me, too.</p></div>", "<form>Name <input></form>", "<script>var p = '<p>';</script>", "<!-- x -->"]
    for _ in range(200):
        blocks = [" ".join(rng.choice(["one", "two,", "three.", "four"]) for _ in range(rng.randint(1, 80))) for _ in range(rng.randint(1, 12))]
        inner = "".join(rng.choice(["<p>{}</p>", "<section class='related-work'><p>{}</p></section>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>"]).format(b) + (rng.choice(parts) if rng.random() < 0.2 else "") for b in blocks)
        page = "<html><head><title>T</title></head><body>" + "".join(rng.sample(parts, 4)) + f"<article>{inner}</article>" + "".join(rng.sample(parts, 3))
        assert html_extract.main_text(page) == "\n".join(blocks)


def page_rows():
    same, small = "<p>equal</p>" * 200, "<p>tiny</p>"
    rows = [(1, "a", same), (2, "b", same), (9, "c", same), (3, "d", small), (4, "e", small), (5, None, None), (6, "f%\r\nx", "café" * 400), (7, "g", "café" * 400), (None, "h", same), (10, "i", "z" * 300_000), (11, "j", "")]
    return rows + [(20, "k", "q" * 2000), (20, "k", "q" * 2000), (19, "l", "q" * 2000), (20, "m", "q" * 2000)]


@pytest.mark.parametrize("groups", [50_000, 0])
def test_warc_round_trip(spark, groups):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    folder = warc.archive_folder(pages)
    index = warc.write(pages, folder, archive_bytes=2000, broadcast_groups=groups)
    assert index.count() == len(rows)
    whole = {(r["page_id"], r["url"], bytes(r["payload"])) for r in warc.resolved(warc.read(index, folder)).collect()}
    assert whole == {(p, u, (h or "").encode()) for p, u, h in rows}
    got = warc.read(index, folder).collect()
    size = lambda h: len((h or "").encode())
    sha = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    assert sorted((repr(r["page_id"]), repr(r["url"]), r["payload_bytes"], r["digest"]) for r in got) == sorted((repr(p), repr(u), size(h), sha(h)) for p, u, h in rows)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append((r["record_type"], r["refers_to"]))
        if r["record_type"] == "response":
            assert hashlib.sha1(r["payload"]).hexdigest() == r["digest"] and r["refers_to"] is None
    assert by[1] == by[2] == [("revisit", 9)] and by[9] == [("response", None)] and by[None] == [("revisit", 9)]
    assert by[3] == by[4] == [("response", None)] and by[6] == [("revisit", 7)] and by[19] == [("revisit", 20)]
    assert sorted(map(repr, by[20])) == sorted(map(repr, [("response", None), ("revisit", 20), ("revisit", 20)]))
    some = warc.read(index.where("page_id in (1, 10)"), folder)
    assert {r["page_id"] for r in some.collect()} == {1, 10}
    name = index.first()["archive"]
    data = open(f"{folder.removeprefix('file://')}/{name}", "rb").read()
    parts = warc.members(data)
    assert sum(map(len, parts)) == len(data) and all(warc.parse_record(p)["whole"] for p in parts)


def payload_exchanges(spark, pages, groups):
    """Written records without ids, and the shuffles of every query of a write that carry payloads."""
    from siltstone.llm import common

    plans, real = [], common._stored_at

    def noted(rows, path):
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plans.append(rows._jdf.queryExecution().explainString(mode))
        return real(rows, path)

    common._stored_at = noted
    try:
        folder = warc.archive_folder(pages)
        records = warc.read(warc.write(pages, folder, archive_bytes=2000, broadcast_groups=groups), folder, payloads=False)
        rows = sorted((r["page_id"], r["record_type"], r["refers_to"] or 0, r["payload_bytes"], r["digest"]) for r in records.collect())
    finally:
        common._stored_at = real
    exchanged = [carried for plan in plans for carried in re.findall(r"\) Exchange\b.*\n(?:Input.*: (.*))", plan)]
    assert exchanged and any("digest" in x for x in exchanged)
    return rows, len(plans), [x for x in exchanged if "html" in x]


def test_warc_ways_agree_and_shuffle_no_payload(spark):
    """Groups of copies broadcast, or records staged: the same records, and no exchange that holds html."""
    rows = [(i, f"u{i}", "<p>same</p>" * 200 if i % 3 == 0 else "q" * 1500 if i % 5 == 0 else f"page {i} " * 150) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    few, plans, moved = payload_exchanges(spark, stored_copy(spark, pages), 50_000)
    many, more, also = payload_exchanges(spark, stored_copy(spark, pages), 0)
    assert few == many and len(few) == 60 and plans >= 2 and more >= 4 and not moved and not also
    assert {r[2] for r in few if r[1] == "revisit"} == {57, 55}


def stored_copy(spark, pages):
    from siltstone.llm.common import stored

    return stored(pages, "pages-copy")


def test_warc_empty_and_ranges(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = warc.archive_folder(pages)
    assert warc.read(warc.write(pages, folder), folder).count() == 0
    assert warc.ranges([(0, 10), (10, 5), (100, 5), (400, 900)], gap=50, most=120) == [(0, 15, 0, 2), (100, 5, 2, 3), (400, 900, 3, 4)]
    assert warc.ranges([(0, 10), (10, 5), (60, 5)], gap=50, most=120) == [(0, 65, 0, 3)]


ESC = "\\### Assistant: </turn> ok"
CHATS = [
    (1, 0, "user", ESC), (1, 1, "assistant", ESC), (1, 2, None, None), (2, 0, "system", ""), (2, 1, "tool: x", "\\\\0 \\1 \\2 #### ##"), (2, 1, "assistant", "é\U0001f600\n</turn>\n### User: "),
    (None, 0, "assistant", "no id"), (3, None, "User", "</turn></turn>"), (3, None, "User", "</turn></turn>"), (3, 5, "assistant", "x" * 50_000), (3, 6, "=a\\3", "\\"),
]


def test_chat_round_trip(spark):
    table = spark.createDataFrame([(*c, 1) for c in CHATS], "conv_id long, turn long, role string, text string, seq int")
    rendered = chat.render(chat.reconstruct(chat.turn_events(table)))
    got = {r["conv_id"]: r for r in chat.summary(rendered).collect()}
    order = lambda c: tuple((v is not None, v or 0 if i == 0 else v or "") for i, v in enumerate(c[1:]))
    for conv in {c[0] for c in CHATS}:
        turns = sorted((c for c in CHATS if c[0] == conv), key=order)
        whole = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in rendered.collect():
        assert r["formatted"].count("###") == r["formatted"].count("</turn>") == len(r["mask"])
    assert chat.summary(chat.render(chat.reconstruct(chat.turn_events(table.where("false"))))).count() == 0


def test_events_fold(spark):
    log = [
        (1, 1, 0, "message", "user", "hello"), (1, 2, 1, "message", "assistant", ""), (1, 3, 1, "delta", None, "wr"), (1, 4, 1, "delta", None, "ong"), (1, 5, 2, "message", "user", "late turn"),
        (1, 6, 1, "regenerate", None, None), (1, 7, 1, "delta", None, "ri"), (1, 8, 1, "delta", None, "ght"), (1, 9, 0, "edit", None, "hi"), (1, 10, 3, "message", "user", "bye"), (2, 1, 0, "delta", "assistant", "b"), (2, 1, 0, "delta", "assistant", "a"),
    ]
    rng = random.Random(1)
    rng.shuffle(log)
    events = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string")
    got = sorted(tuple(r) for r in chat.reconstruct(events).collect())
    assert got == [(1, 0, "user", "hi"), (1, 1, "assistant", "right"), (1, 3, "user", "bye"), (2, 0, "assistant", "ab")]


def fold(log):
    """The same events folded one after the other; a role once named stays, whatever becomes of the text."""
    talks, roles = {}, {}
    for conv, _, turn, kind, role, text in sorted(log, key=lambda e: (str(e[0]), e[1], e[5] or "")):
        turns = talks.setdefault(conv, {})
        if kind == "regenerate":
            for later in [t for t in turns if t > turn]:
                del turns[later]
        if role is not None:
            roles[conv, turn] = role
        turns[turn] = (turns.get(turn, "") if kind == "delta" else "") + (text or "")
    return {(c, t, roles.get((c, t), ""), x) for c, turns in talks.items() for t, x in turns.items()}


def test_random_logs_against_a_fold(spark):
    rng = random.Random(41)
    log = []
    for conv in range(60):
        for seq in range(rng.randint(1, 30)):
            kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate", "odd"])
            log.append((conv, seq, rng.randint(0, 4), kind, rng.choice([None, "user", "assistant"]), rng.choice([None, "", f"t{seq} "])))
    want = fold(log)
    rng.shuffle(log)
    events = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string").repartition(4)
    assert {tuple(r) for r in chat.reconstruct(events).collect()} == want


def test_streamed_events_fold_to_the_turns(spark):
    table = spark.createDataFrame([(*c, 1) for c in CHATS], "conv_id long, turn long, role string, text string, seq int")
    events = chat.streamed_events(table)
    assert {"message", "delta", "edit", "regenerate"} == {r[0] for r in events.select("kind").distinct().collect()}
    read = lambda e: sorted(map(repr, chat.summary(chat.render(chat.reconstruct(e))).collect()))
    assert read(events) == read(chat.turn_events(table))


def vectors(n=600, dim=16):
    x = np.random.default_rng(1).normal(size=(n, dim)).astype(np.float32)
    rows = [(i, x[i].tolist()) for i in range(n)] + [(1000 + i, x[5].tolist()) for i in range(40)]
    rows += [(2000, None), (2100, [0.0] * dim), (2200, [float("nan")] + [1.0] * (dim - 1)), (2300, [None] + [1.0] * (dim - 1)), (2400, [float("inf")] * dim), (2500, [1.0, 2.0]), (300, x[300].tolist())]
    return rows


def brute_force(rows, k=10):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v is not None and len(v) == 16 and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = []
    for at, (q, x) in enumerate(good):
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for j, (i, v) in enumerate(good) if j != at)
            out.append((q, near[:k]))
    return out


def test_search_recall(spark):
    rows = vectors()
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    got = {}
    for r in ann.search(table, F.col("vec_id") % 100 == 0, block=200, query_block=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    want = brute_force(rows)
    assert set(got) == {q for q, _ in want}
    hits = total = 0
    for q, near in want:
        found = sorted(got[q])
        n = sum(1 for a, _ in want if a == q)
        assert len(found) == 10 * n
        ids = {i for _, _, i in found}
        hits += len(ids & {i for _, i in near})
        total += len(near)
        scores = [s for _, s, _ in found]
        assert scores == sorted(scores)
    assert hits / total >= 0.9


def test_search_exhausts_small_tables(spark):
    rows = [(100 * i, [float(i), 1.0]) for i in range(1, 8)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 100).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(i, 100 * (i + 1), float(i)) for i in range(1, 7)]


def test_footrule_of_nearest_pivots():
    """Places, and the order of the nearest pivots, against a full sort."""
    rng = np.random.default_rng(3)
    x, pivots = rng.normal(size=(50, 8)), rng.normal(size=(40, 8))
    full = np.argsort(((x[:, None] - pivots[None]) ** 2).sum(axis=2), axis=1, kind="stable")
    near = ann.permutations(x, pivots, 12)
    assert (near == full[:, :12]).all() and (ann.permutations(x, pivots, 64) == full).all()
    place = [{int(p): k for k, p in enumerate(row)} for row in near]
    for q in range(50):
        q_place = np.full(40, 12, dtype=np.int16)
        q_place[near[q]] = np.arange(12)
        want = [sum(abs(place[i].get(p, 12) - place[q].get(p, 12)) for p in range(40)) for i in range(50)]
        assert ann.footrules(near, q_place).tolist() == want
    assert ann.permutations(x, pivots).dtype == np.uint16 and ann._number(70_000) == np.uint32
    assert [ann.pivot_count(n) for n in (0, 2_000, 10**6, 10**9)] == [128, 256, 4096, 1 << 17]


def test_footrule_decides_at_the_size_of_the_tables(spark):
    """Reranking all that is met finds more than the share that footrule lets through, and the share is enough."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    hits = {}
    for share in (ann.RERANK, 1.0):
        hits[share] = 0
        for r in ann.search(table, F.col("vec_id") % 100 == 0, rerank=share).collect():
            d = np.sqrt(((x - x[r["query_id"]]) ** 2).sum(axis=1))
            d[r["query_id"]] = np.inf
            hits[share] += r["vec_id"] in set(np.argsort(d, kind="stable")[:10].tolist())
    assert 180 <= hits[ann.RERANK] < hits[1.0]


def test_search_recall_at_more_vectors(spark):
    """Clustered vectors in double precision, null ids among them; recall against brute force."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 24))[rng.integers(0, 60, 3000)] + 0.6 * rng.normal(size=(3000, 24))
    rows = [(i if i % 7 else (None if i % 700 == 7 else i), v.tolist()) for i, v in enumerate(x)] + [(None, x[5].tolist())]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 100 == 0).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    hits = 0
    for q, near in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len({i for _, i in near} & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert len(found) == 30 and all(len(n) == 10 for n in found.values()) and hits >= 0.9 * 300


def test_search_nothing(spark):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert ann.search(none, F.col("vec_id") > 0).count() == 0
    assert ann.search(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"), F.col("vec_id") > 5).count() == 0
