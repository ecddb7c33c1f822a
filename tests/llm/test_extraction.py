"""Repeated runs against brute force, over groups of a host, and broken markup."""

import random
import time
from collections import defaultdict

import numpy as np
import pytest

from quillspan.llm import extract


def brute_repeated(streams, run, pages):
    where = defaultdict(set)
    for k, s in enumerate(streams):
        for i in range(len(s) - run + 1):
            where[tuple(s[i : i + run])].add(k)
    out = []
    for s in streams:
        marks = [False] * len(s)
        for i in range(len(s) - run + 1):
            if len(where[tuple(s[i : i + run])]) >= pages:
                marks[i : i + run] = [True] * run
        out.append(marks)
    return out


@pytest.mark.parametrize("run", [1, 2, 3, 5, 8])
def test_repeated_brute_force(run):
    rng = random.Random(run)
    for _ in range(40):
        streams = [[rng.randrange(3) for _ in range(rng.randrange(30))] for _ in range(rng.randrange(1, 8))]
        plan = extract.PagePlan(run=run, pages=rng.randrange(2, 4))
        got = extract.repeated([np.array(s, np.int64) for s in streams], plan)
        assert [g.tolist() for g in got] == brute_repeated(streams, run, plan.pages)


NOTICE = "sign up now for our weekly letter and never again miss a single story of the town"


def site(n):
    rng = random.Random(n)
    story = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40))
    rows = []
    for k in range(n):
        own, more = story(), story()
        extra = f"<p>{NOTICE}</p>" if k % 17 == 0 else ""
        rows.append((k, f"http://h.example/{k}", f"<article><p>{own}</p>{extra}<p>{more}</p></article><footer>end</footer>", f"{own} {more}"))
    return rows


def test_anchors():
    rng = random.Random(4)
    for n in (0, 1, 5, 8, 9, 60):
        h = np.array([rng.randrange(6) for _ in range(n)], np.int64)
        at = extract.anchors(h, 8).tolist()
        want = {k for i in range(max(1, n - 7)) for k in range(i, min(n, i + 8)) if h[k] == h[i : i + 8].min()} if n else set()
        assert at == sorted(want)


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_common(batch):
    """Parts of a hash that comes to three pages, however the batches cut its rows."""
    import pyarrow as pa

    rng = random.Random(batch)
    rows = sorted((rng.randrange(60), k, rng.randint(1, 2)) for k in range(120)) + [(99, k, 1) for k in range(2)]
    batches = [pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows[i : i + batch]], pa.int64()) for c in (1, 0, 2)], names=["part", "hash", "n"]) for i in range(0, len(rows), batch)]
    got = [(r["hash"], r["part"]) for b in extract._common(extract.PagePlan())(iter(batches)) for r in b.to_pylist()]
    total = defaultdict(int)
    for h, _, n in rows:
        total[h] += n
    assert sorted(got) == [(h, k) for h, k, _ in sorted(rows) if total[h] >= 3]


@pytest.mark.parametrize("group,bound", [(1000, 500_000), (8, 500_000), (8, 0)])
def test_notice_in_the_container(spark, group, bound):
    """A notice on 4 pages of a host goes, from the container too and whatever the number of groups."""
    rows = site(60)
    docs = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract.main_text(docs, extract.PagePlan(group=group, broadcast_rows=bound)).collect()}
    assert got == {r[0]: r[3] for r in rows}
    alone = {r.page_id: r.text for r in extract.main_text(docs.where("page_id = 17")).collect()}
    assert NOTICE in alone[17]


def test_rows(spark):
    rows = [(1, "http://h.example/", "<p>a b</p>")] * 5 + [(1, "http://h.example/", "<p>c</p>"), (None, None, None), (2, "x", "")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("page_id", "url", "html", "1 as host", "2 as part")
    for group in (128, 2):
        got = extract.main_text(docs, extract.PagePlan(group=group)).collect()
        assert sorted((r.page_id or 0, r.text) for r in got) == [(0, "")] + [(1, "a b")] * 5 + [(1, "c"), (2, "")]
    assert extract.main_text(docs.limit(0)).count() == 0
    long = "word " * 200_000
    got = extract.main_text(spark.createDataFrame([(1, "http://h/", f"<article>{long}</article>")], "page_id long, url string, html string")).first()
    assert got.text == long.strip() and got.n_chars == len(long) - 1


def test_unique_runs_stay():
    unique = lambda k: " ".join(f"u{i}of{k}" for i in range(9))
    shared = " ".join(f"s{k}" for k in range(60))
    pages = [f"<main><p>{shared} {unique(k)}</p><p>{' '.join(f'x{k}y{i}' for i in range(90))}</p></main>" for k in range(3)]
    for k, (text, _) in enumerate(extract.main_texts(pages, extract.PagePlan())):
        assert text == f"{unique(k)} " + " ".join(f"x{k}y{i}" for i in range(90))


@pytest.mark.parametrize("html", ['<a ' * 300_000, '<div class="' * 90_000, '<div class="' * 90_001 + ">", "</b></div>" * 100_000, "<div>" * 200_000 + "</p>" * 100_000, '<a "x>" ' * 120_000, "<svg>" * 200_000, "<!" * 500_000, "<p>a" * 250_000, "&amp" * 250_000])
def test_broken_markup_is_linear(html):
    began = time.process_time()
    extract.blocks(html)
    assert time.process_time() - began < 5


def test_markup():
    page = """<title>no</title><p class=don't>a &lt;b&gt; <i y="1>2">c</i></p> 1 < 2 <!-- no > --><script>var a = "</p>";</script><math>x</math><div class='notice-period byline related'>d</div><div class="ad big">no</div><article><div class="related"><p>e</p></div><div class="comments">no</div></article>"""
    assert [x for x in extract.blocks(page) if x[0]] == [(1, "a <b> c"), (1, "1 < 2"), (1, "x"), (2, "e")]
    kept = "<article><div class='byline'>by x</div><div class='notice-period'><p>b</p></div><div class='promotion-theory'>c</div><math>y</math></article>"
    assert extract.main_texts([kept], extract.PagePlan())[0][0] == "by x b c y"


def text(page):
    return extract.main_texts([page], extract.PagePlan())[0][0]


def test_comments_and_cards():
    """Reader comments go from a container, whatever element holds them; cards and buttons too."""
    story = "<p>The story has a dozen words in it, so that it is most of the page.</p>"
    told = "The story has a dozen words in it, so that it is most of the page."
    for other in (
        '<article class="comment">Reader says hello</article>', '<article>Related card</article>', '<div class="comment-list"><p>Reader</p></div>', '<section id="reader-comments">Reader</section>', '<ol class="commentlist comments">Reader</ol>',
        '<div class="share-buttons">Share</div>', '<div class="cookie-notice">We use cookies</div>', '<div class="ad-slot">Buy</div>', '<p class="ad">Buy</p>', '<p class="comment">Reader</p>', '<aside>More</aside>', '<div class="newsletter_signup">Sign up</div>',
    ):
        assert text(f"<main><article>{story}{other}</article></main>") == told, other
    assert text(f'<main><article>{story}</article><article class="comment">Reader says hello</article></main>') == told
    assert text(f'<main><article id="user-comment-1">x</article><article class="post comments-open social">{story}</article></main>') == told
    assert text(f"<main><article>{story}</article><article><p>And a second one.</p></article></main>") == f"{told} And a second one."


def test_own_paragraphs_stay():
    """Class words never drop an article's own paragraph, unless they say comment or advert."""
    for name in ("social", "menu", "respond", "overlay", "share", "footer", "notice", "related", "share-price"):
        assert text(f'<article><p>First.</p><p class="{name}">The {name} paragraph.</p><h2 id="{name}">Head</h2></article>') == f"First. The {name} paragraph. Head"
    assert text('<article><p>Read <a class="share">on</a> <span class="nav">here</span>.</p></article>') == "Read on here."


def test_text_around_a_card():
    """A container that has little of a page's text doesn't exclude the rest."""
    assert text("<p>Story starts.</p><article><p>Teaser card</p></article><p>Story goes on.</p>") == "Story starts. Teaser card Story goes on."
    assert text("<p>Site</p><article><p>The whole story.</p></article><p>Imprint</p>") == "The whole story."
    frame = " ".join(f"frame{k}" for k in range(40))
    own = [" ".join(f"w{k}of{i}" for k in range(12)) for i in range(4)]
    got = extract.main_texts([f"<div>{frame}</div><article><p>{x}</p></article>" for x in own], extract.PagePlan())
    assert [t for t, _ in got] == own  # what repeats outside is no text that the container would have to outweigh


def brute_text(page, marks, plan):
    """The rule for a page's text, block by block, from the words that repeat."""
    words = [(zone, t.split(" ")) for zone, t in page]
    told, at = [], 0
    for zone, w in words:
        told.append((zone, w, marks[at : at + len(w)]))
        at += len(w)
    inside = sum(len(w) for zone, w, _ in told if zone == 2)
    outside = sum(m.count(False) for zone, _, m in told if zone == 1)
    unmarked = [x for zone, _, m in told if zone for x in m]
    copy = bool(unmarked) and sum(unmarked) / len(unmarked) > plan.copy
    out = []
    for zone, w, m in told:
        if zone == 0 or zone == 1 and inside > outside:
            continue
        if copy or sum(m) / len(m) < plan.cover:
            out += w
            continue
        run = []
        for word, gone in [*zip(w, m, strict=True), ("", True)]:
            if not gone:
                run.append(word)
            else:
                out += run if len(run) >= plan.run else []
                run = []
    return " ".join(out)


@pytest.mark.parametrize("seed", range(3))
def test_query_brute_force(spark, seed):
    """The query's texts on hosts of one group: repeated runs by brute force over each host, then the rule."""
    rng, plan = random.Random(seed), extract.PagePlan(run=3, pages=2)
    word = lambda: rng.choice("abcdefghijklmnop") * rng.randint(1, 3)
    shared = [" ".join(word() for _ in range(rng.randint(2, 9))) for _ in range(6)]

    def block():
        parts = [rng.choice(shared) if rng.random() < 0.5 else " ".join(f"{word()}{rng.randrange(10**6)}" for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 3))]
        return f"<{rng.choice(['p', 'div', 'p class=menu', 'h2'])}>{' '.join(parts)}"

    def page():
        around = lambda: "".join(block() + "</p>" for _ in range(rng.randint(0, 2)))
        return around() + rng.choice(["<article>", "<main>", "<section>", "<nav>"]) + "".join(block() + "</p>" for _ in range(rng.randint(0, 4))) + rng.choice(["</article>", "</main>", "</section>", "</nav>"]) + around()

    rows = [(k, f"http://h{k % 3}.example/{k}", page()) for k in range(45)]
    rows += [(100, "http://h0.example/again", rows[0][2]), (101, "http://h1.example/none", None)]
    got = {r.page_id: (r.text, r.n_chars) for r in extract.pages_query(spark.createDataFrame(rows, "page_id long, url string, html string"), plan).collect()}
    for host in range(3):
        mine = [(i, extract.blocks(h)) for i, url, h in rows if f"//h{host}." in url]
        marks = brute_repeated([" ".join(t for _, t in page).split() for _, page in mine], plan.run, plan.pages)
        for (i, parsed), m in zip(mine, marks, strict=True):
            want = brute_text(parsed, m, plan)
            assert got[i] == (want, len(want)), (i, parsed, m)
    assert got[101] == ("", 0) and sum(bool(t) for t, _ in got.values()) > 20


def test_word_hashes():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abé\u3000") for _ in range(rng.choice([1, 2, 3, 300, 700])))
    pages = [[word() for _ in range(rng.randrange(9))] for _ in range(60)]
    texts = [b"".join(w.encode() + (b"" if k == len(p) - 1 else rng.choice([b" ", b"\n"])) for k, w in enumerate(p)) for p in pages]
    hashes, size = extract.word_hashes(texts, most=7)
    words = [w for p in pages for w in p]
    assert size.tolist() == [len(p) for p in pages] and len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
    assert [len(x) for x in extract.word_hashes([b"", b""])] == [0, 2]


@pytest.mark.parametrize("raw", [0, 1, 6])
def test_code(raw):
    rng = np.random.default_rng(raw)
    values = np.unique(rng.integers(0, 2**64, 500, np.uint64) >> rng.integers(0, 60, 500).astype(np.uint64))
    pages = rng.integers(1, 4, len(values))
    got = extract.decode(extract.code(values, pages, raw), len(values), raw)
    assert (got[0] == values).all() and (got[1] == pages).all()


@pytest.mark.parametrize("run", [1, 3, 8])
def test_section_brute_force(run):
    """The words in suffixes that enough pages of a section share, by name."""
    rng = random.Random(run)
    for _ in range(40):
        streams = [[rng.randrange(3) for _ in range(rng.randrange(40))] for _ in range(rng.randrange(1, 8))]
        plan = extract.PagePlan(run=run, pages=rng.randrange(2, 4))
        found = extract.section([" ".join(map(str, s)).encode() for s in streams], rng.randrange(2**64), plan)
        assert [m.tolist() for m in found.marks(found.pages >= plan.pages, run)] == brute_repeated(streams, run, plan.pages)


def long_host(n):
    """Pages most of which share no more than a run with two others, of the length of a run to twice that, at the beginning of a block."""
    rng = random.Random(n)
    own = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(k))
    shared = [own(rng.randint(8, 19)) for _ in range(n // 3)]
    return [(k, f"http://h.example/{k}", f"<div>{own(3)}</div><article><p>{own(25)}</p><p>{shared[k % len(shared)]} {own(rng.randint(0, 5))}</p></article>") for k in range(n)]


def test_one_rule_at_every_size(spark):
    """However many groups a host is dealt to, its texts are those of one suffix array: runs of 8 to 19 words at the beginning of a block too."""
    rows = long_host(400) + [(900, "http://h.example/again", None), *[(901, "http://h.example/copy", "<p>a copy has a text of its own, of more than eight words</p>")] * 9]
    want = extract.main_texts([r[2] for r in rows], extract.PagePlan())
    expected = sorted((r[0], *w) for r, w in zip(rows, want, strict=True))
    assert sum(n > 0 for _, _, n in expected) == 3 * 133 + 1 + 9
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    for group in (128, 1000, 11):
        got = extract.main_text(docs, extract.PagePlan(group=group)).collect()
        assert sorted((r.page_id, r.text, r.n_repeated) for r in got) == expected, group


def test_pages_are_shuffled_once(spark):
    plan = extract.main_text(spark.createDataFrame(long_host(9), "page_id long, url string, html string"), extract.PagePlan(group=3))
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert text.count("mapInArrow") + text.count("MapInArrow") == 1 or text.count("ReusedExchange") >= 2, text
