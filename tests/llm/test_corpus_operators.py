"""The corpus operators against brute force, and on the awkward cases that each defines."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspan.llm import chat, decontam, extract, language, lines, mixing, pii, quality, simhash, sketch
from quillspan.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "ridge lantern copper violet harbor meadow quarry timber saddle thistle marble canyon ember willow falcon granite hollow juniper kettle linen".split()


def make(spark, texts, start=0, lang="en", source="a"):
    return spark.createDataFrame([(start + i, t, lang, source, len(t or "")) for i, t in enumerate(texts)], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 1)] + [(i, i + 1) for i in range(20, 60)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found[3] == found[2] == found[1] == 1 and found[9] == 8 and {found[i] for i in range(20, 61)} == {20} and 5 not in found


@pytest.mark.parametrize("band", [1, 2, 3])
def test_edit_distance(band):
    rng = random.Random(3)
    a = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 15))) for _ in range(800)]
    b = ["".join(c for c in x if rng.random() > 0.1) + rng.choice(["", "a", "bc"]) for x in a]
    assert [min(levenshtein(x, y), band + 1) for x, y in zip(a, b)] == lines.edit_distances(a, b, band).tolist()


@pytest.mark.parametrize("hot", [4096, 40, 3])
def test_lines_brute_force(spark, hot):
    rng = random.Random(5)
    pool = [prose(rng, rng.randint(4, 9)) for _ in range(30)]

    def edited(x):
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(x))
            x = rng.choice([x[:k] + x[k + 1 :], x[:k] + "q" + x[k:], x[:k] + "z" + x[k + 1 :]])
        return x

    texts = ["\n".join([edited(rng.choice(pool)) for _ in range(rng.randint(1, 6))] + ["short"]) for _ in range(80)]
    got = {r.doc_id: r.text for r in lines.lines_query(make(spark, texts), lines.LinePlan(hot=hot)).collect()}
    seen = []
    for d, t in enumerate(texts):
        kept = []
        for line in t.split("\n"):
            gone = line in seen or len(line) >= 20 and any(len(x) >= 20 and abs(len(line) - len(x)) <= 2 and levenshtein(line, x) <= 2 for x in seen)
            if not gone:
                kept.append(line)
            seen.append(line)
        assert got[d] == "\n".join(kept), d


def test_lines_of_one_template(spark):
    """Hundreds of different lines share a segment: the refinement by parity and cells loses no link and makes none up."""
    rng = random.Random(11)
    found = sorted({f"the same beginning of a line {rng.randint(100, 180)} and {rng.choice('abcdef')}{rng.choice('uvw')}" for _ in range(400)})
    texts = ["\n".join(found[i::20]) for i in range(20)]
    links = sum(levenshtein(x, y) <= 2 for x, y in combinations(found, 2))
    for hot in (4096, 60, 8):
        got = lines.lines_query(make(spark, texts), lines.LinePlan(hot=hot)).collect()
        assert sum(r.n_links for r in got) == 2 * links


def test_links_leave_as_rows_of_lines(spark):
    """Near copies of one line, each linked with each: the rows between the stages grow with the lines, not with the links."""
    base = "a line that many documents share with a small change"
    found = [base[:k] + c + base[k + 1 :] for k in range(len(base)) for c in "#@+=" if base[k] != c]
    docs = make(spark, found)
    plan = lines.LinePlan()
    entries = lines._candidates(docs.select("text").mapInArrow(lines._keyed(plan), "key long, id long, parity long"), plan)
    assert entries.count() < 30 * len(found)
    got = lines.lines_query(docs, plan).collect()
    assert sum(r.n_links for r in got) == len(found) * (len(found) - 1) and sum(r.n_removed for r in got) == len(found) - 1


def test_equal_first_hashes_tell_lines_apart(spark, monkeypatch):
    """Lines whose first hashes collide are different lines."""
    real = lines.line_ids
    monkeypatch.setattr(lines, "line_ids", lambda t, n: [(k, x, 7, h2) for k, x, _, h2 in real(t, n)])
    a, b = "one line of the usual length that is long", "quite another text which has nothing in common"
    occurrences = lines._occurrences(lines.LinePlan())
    import pyarrow as pa

    rows = pa.Table.from_batches(occurrences(iter([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([a, b])], names=["d", "t"])]))).to_pylist()
    assert {(r["h1"], len({r["h2"] for r in rows})) for r in rows} == {(7, 2)}
    h1 = lines._signed(xxhash.xxh64_intdigest(a.encode(), 1))
    assert lines.strip_lines(f"{a}\n{b}", [h1 + 1], lines.LinePlan()) == (f"{a}\n{b}", 0)
    assert lines.strip_lines(f"{a}\n{b}", [h1], lines.LinePlan()) == (b, 1)


def brute_simhash(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("long_list", [48, 2])
def test_simhash_brute_force(spark, long_list):
    rng = random.Random(8)
    base = [prose(rng, 60) for _ in range(25)]
    texts = [" ".join(w if rng.random() > 0.01 else "changed" for w in rng.choice(base).split(" ")) for _ in range(160)] + [None, "", "one two", "One TWO", "İx ab", " "]
    got = {r.doc_id: r for r in simhash.near_duplicates(make(spark, texts), long_list).collect()}
    fps = [brute_simhash(t) for t in texts]
    assert all(got[i].fp % 2**64 == f for i, f in enumerate(fps))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert [got[i].component_id for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    kept = {r.doc_id for r in simhash.keep_first(make(spark, texts)).collect()}
    assert kept == {find(i) for i in range(len(texts))}


def test_simhash_cases(spark):
    docs = spark.createDataFrame([(None, "a b c d", None, None, None), (4, "a b c d", None, None, None), (4, "a b c d", None, None, None)], DOCS)
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} == {4}
    assert simhash.keep_first(docs).count() == 3
    assert simhash.simhash_query(docs.limit(0)).count() == 0


def brute_tokens(text):
    out = []
    for m in re.finditer(r"[^\W_]+|%", text or ""):
        out.append(m[0].lower())
    return [t for t in out if t != "%"]


def test_decontamination(spark):
    rng = random.Random(2)
    items = [prose(rng, n) for n in (9, 14, 30, 40)] + ["Then Anna Smith drove 40 km to the old harbor town and Anna paid 7 dollars for the ferry", None, "", "two words"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    clean = [prose(random.Random(100 + k), 120) for k in range(20)]
    swapped = "Then Maria Jones drove 95 km to the old harbor town and Maria paid 3 dollars for the ferry"
    clashing = "Then Maria Jones drove 95 km to the old harbor town and Peter paid 3 dollars for the ferry"
    texts = clean + [f"{clean[0]} {items[0]} {clean[1]}", f"{clean[2]} {items[1]}.", items[2].upper() + " tail", f"{clean[3]} " + " ".join(items[3].split()[10:30]), f"Before, {swapped}. After", f"Before, {clashing}. After", None, ""]
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(make(spark, texts), bench).collect()}
    assert got == {(20, 0), (21, 1), (22, 2), (23, 3), (24, 4)}
    left = {r.doc_id for r in decontam.decontaminate(make(spark, texts).withColumnRenamed("source", "w"), bench).collect()}
    assert left == set(range(20)) | {25, 26, 27}
    assert decontam.leaks(make(spark, texts), bench.limit(0)).count() == decontam.leaks(make(spark, texts).limit(0), bench).count() == 0


def test_decontamination_probes_every_window(spark):
    """One changed token leaves two windows of the same residue, at any place of the document."""
    words = [w + x for x in ("", "s", "ed") for w in WORDS]
    item = words[:17]
    long = [w if k % 9 != 8 else "changed" for k, w in enumerate(words)]
    edited = item[:8] + ["changed"] + item[9:]
    texts = [" ".join(["x"] * k + some + ["y"] * 5) for k in range(6) for some in (edited, long)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(words))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(make(spark, texts), bench).collect()}
    assert got >= {(2 * k, 1) for k in range(6)} | {(2 * k + 1, 2) for k in range(6)}


def test_decontamination_is_native(spark):
    plan = decontam.leaks(make(spark, ["a b"]), spark.createDataFrame([(1, "a b")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pfair_windows():
    rng = random.Random(4)
    for _ in range(30):
        shares = mixing.integer_shares({f"s{k}": rng.random() ** 3 + 1e-3 for k in range(rng.randint(1, 40))}, 200)
        order, period = mixing.pfair_period(shares), sum(shares.values())
        assert Counter(order) == shares
        seen = Counter()
        for t, k in enumerate(order, 1):
            seen[k] += 1
            assert all(abs(seen[s] - t * n / period) < 1 for s, n in shares.items())


def test_mixing(spark):
    rows = [(i, "t", "en", "big" if i % 3 else ("small" if i % 2 else None), 1) for i in range(900)] + [(5, "t", "en", "big", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    plan = mixing.MixPlan(block=4, period=50, rows_per_bucket=37)
    out = mixing.mixed(docs, None, plan).collect()
    assert Counter((r.doc_id, r.source) for r in out if r.mix_epoch == 0) == Counter((r[0], r[3]) for r in rows)
    assert len({r.mix_position for r in out}) == len(out)
    sizes = Counter(r[3] or "" for r in rows)
    shares = mixing.integer_shares({k: n**plan.temperature for k, n in sizes.items()}, plan.period)
    by = {}
    for r in sorted(out, key=lambda r: r.mix_position):
        by.setdefault(r.mix_slot, set()).add(r.source or "")
    assert sorted(by) == list(range(len(by))) and all(len(s) == 1 for s in by.values())
    seen = Counter()
    for t in range(len(by)):
        seen.update(by[t])
        assert all(abs(seen[k] - (t + 1) * n / plan.period) < 1 for k, n in shares.items())
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert {r.source for r in mixing.mixed(docs, {"big": 1.0}, plan).collect()} == {"big"}


@pytest.mark.parametrize("bound", [8_000_000, 0])
def test_mixing_follows_the_weights(spark, bound):
    """Prefixes keep within one block of the weights themselves, with more sources than a rounded period can tell apart."""
    docs = spark.createDataFrame([(i, "t", "en", "hot" if i < 3000 else f"s{i}", 1) for i in range(3300)], DOCS)
    weights = {"hot": 0.5} | {f"s{i}": 0.5 / 300 for i in range(3000, 3300)}
    plan = mixing.MixPlan(block=2) if bound else mixing.MixPlan(block=2, broadcast_slots=0)
    slots = {r.mix_slot: r.source for r in mixing.mixed(docs, weights, plan).collect()}
    assert sorted(slots) == list(range(len(slots))) and len(slots) > 2990
    seen = Counter()
    for t in range(len(slots)):
        seen[slots[t]] += 1
        assert all(abs(seen[k] - (t + 1) * w) < 1 for k, w in weights.items())


EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"


def brute_spans(t):
    t = t or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(EMAIL, t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(IP, t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]


def test_base_spans():
    rng = random.Random(6)
    for _ in range(4000):
        t = "".join(rng.choice(["a@b.c", ".", "@", "12", "4", "+49", " ", "-", "(", ")", "é", "x_", "10.0.0.1", "4111 1111 1111 1111", "256", "%"]) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(t) == brute_spans(t), t
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 200_000) == [] and pii.base_spans(None) == []


def test_sanitise(spark):
    secret = [f"write to boss@corp.example about zephyrium today {k}" for k in range(4)]
    rest = [prose(random.Random(k), 40) for k in range(60)] + [None, "", "no words 10.0.0.1"]
    got = {r.doc_id: r.privacy for r in pii.sanitise(make(spark, secret + rest)).collect()}
    assert "zephyrium" not in got[0].sanitised and "boss@corp" not in got[0].sanitised and got[0].n_email == 1
    assert got[0].base_sha256 == hashlib.sha256(b"email:9:26").hexdigest() and got[0].spans.startswith("email:9:26,term:")
    assert got[64].sanitised is None and got[64].base_sha256 == hashlib.sha256(b"").hexdigest() and got[66].n_ip == 1
    assert pii.privacy_query(make(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("bound", [100_000, 1])
def test_sanitise_whole_documents(spark, bound):
    """A revealing term goes wherever it is written, and counts wherever in a document it is."""
    rng = random.Random(5)
    far = lambda: prose(rng, 60)
    texts = [f"write to boss@corp.example about zephyrium {far()} Zephyrium" for _ in range(3)]
    texts += [f"call ann@corp.example {far()} quixotica" for _ in range(4)] + [f"{far()} zephyrium", "nothing here"]
    docs = make(spark, texts + [prose(rng, 40) for _ in range(60)]).union(spark.createDataFrame([(None, f"{far()} quixotica", None, None, None)], DOCS))
    got = {r.doc_id: r.privacy for r in pii.sanitise(docs, pii.PrivacyPlan(broadcast_rows=bound)).collect()}
    assert not [k for k, p in got.items() if re.search("zephyrium|quixotica", p.sanitised, re.I)]
    assert got[7].n_terms == 1 and got[7].spans.startswith("term:") and got[8].sanitised == "nothing here" and got[20].n_terms == 0


def test_sketch(spark):
    rng = random.Random(9)
    a, b = prose(rng, 3000).split(" "), prose(rng, 3000).split(" ")
    plan = sketch.SketchPlan(k=256)
    for cut in (0, 700, 1500, 3000):
        x, y = " ".join(a), " ".join(a[:cut] + b[cut:])
        sx, sy = set(sketch.shingle_hashes(x, 5).tolist()), set(sketch.shingle_hashes(y, 5).tolist())
        px, py = sketch.sketch(x, plan), sketch.sketch(y, plan)
        assert px.tolist() == sorted(sx)[:256]
        assert abs(sketch.resemblance(px, py, 256) - len(sx & sy) / len(sx | sy)) < 0.12
        assert abs(sketch.containment(px, py, 256) - len(sx & sy) / len(sx)) < 0.2
        assert abs(sketch.distinct_count(px, 256) / len(sx) - 1) < 0.25
        assert sketch.merge(px, py, 256).tolist() == sorted(sx | sy)[:256]
    texts = [None, "", "one two", "one two", prose(rng, 30), prose(rng, 400), "é" * 7]
    for ranges in (2, 8000):
        got = {r.doc_id: r for r in sketch.fingerprint_query(make(spark, texts), sketch.SketchPlan(rows_per_range=ranges)).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            e = sketch.edited(t, texts[(i + 1) % len(texts)])
            assert got[i].n_chars == len(t or "") and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
            assert got[i].edited_fingerprint == sketch.to_text(sketch.sketch(e))
        assert got[2].fingerprint == got[3].fingerprint and got[2].near_next == 1.0
    assert sketch.fingerprint_query(make(spark, []).limit(0)).count() == 0


def test_extraction(spark):
    boiler = "<div>we keep small files on your device to make things work well</div>"
    page = lambda k: f"<html><body>{boiler}<div>unique story number {k} {prose(random.Random(k), 25)}</div><div class='comments'>nice</div></body></html>"
    framed = "<nav>menu</nav><article><h1>T &amp; C</h1><p>a  b<b>c</b><p>d<script>var x='</p>'</script><aside>no</aside></article><footer>f</footer>"
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(6)] + [(10, "http://i.example/", framed), (11, None, None), (12, "x", ""), (10, "http://i.example/", framed)]
    got = [(r.page_id, r.text, r.n_chars) for r in extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert Counter(p for p, _, _ in got) == Counter(r[0] for r in rows)
    for p, t, n in got:
        assert n == len(t)
        assert t == (f"unique story number {p} {prose(random.Random(p), 25)}" if p < 6 else "T & C a bc d" if p == 10 else "")


def test_repeated_blocks_in_the_container_go():
    notice = "<p>sign up for our weekly letter and never miss a story again</p>"
    stories = [f"story number {k} {prose(random.Random(k), 40)}" for k in range(5)]
    pages = [f"<body><main>{notice}<p>{s}</p></main></body>" for s in stories]
    assert [t for t, _ in extract.main_texts(pages, extract.PagePlan())] == stories
    copies = [f"<article><p>{stories[0]}</p></article>"] * 3
    assert [t for t, _ in extract.main_texts(copies, extract.PagePlan())] == [stories[0]] * 3


def test_suffix_order():
    t = np.random.default_rng(1).integers(0, 3, 60)
    order, _ = extract.suffix_order(t, 64)
    assert order.tolist() == sorted(range(60), key=lambda i: t[i:].tolist())


def test_chat(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"turn {t} of {c}" + "?" * (1 - t % 2)) for c in range(60) for t in range(6)] + [(90, None, None, None), (91, 0, "user", ""), (0, 0, "user", "turn 0 of 0?")]
    got = {r.conv_id: r for r in chat.chat_query(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 62 and sum(got[c].roles == got[c].gold_roles for c in range(60)) >= 48
    hmm = chat.fit([])
    turns = chat.parse(hmm, "System: be brief\nHuman: hello\nhow are you?\nAI: fine\nUser: ok")
    assert turns == [("system", "be brief"), ("user", "hello\nhow are you?"), ("assistant", "fine"), ("user", "ok")]
    assert chat.render(turns[:1]) == "<|system|>\nbe brief\n<|end|>" and chat.parse(hmm, None) == chat.parse(hmm, " \n") == []


def test_viterbi_brute_force():
    from itertools import product

    hmm = chat.fit([])
    ls = ["User: a", "b?", "Bot: c", "d"]
    seen = [chat.split_marker(x) for x in ls]

    def score(path):
        s = hmm.start[path[0]] + sum(hmm.move[a, b] for a, b in zip(path, path[1:]))
        return s + sum(hmm.sign[p, chat.SIGNS.index(m)] + hmm.shape[p, chat.shape(r)] for p, (m, r) in zip(path, seen))

    assert score(chat.viterbi(hmm, ls)) == pytest.approx(max(score(p) for p in product(range(6), repeat=4)))


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_query(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.97
    none = make(spark, [None, "", "x"])
    assert {r.score for r in quality.quality_query(none, labels.limit(0)).collect()} == {0.5}
    assert all(0 <= r.score <= 1 for r in quality.quality_query(none, labels).collect())
    assert quality.quality_query(none.limit(0), labels).count() == 0


def test_features_of_all_words():
    words = ["word"] * 4096
    for k in range(1, 4096, 8):  # a sample of every eighth word sees none of them
        words[k] = "x" * 21 + "!"
    assert quality.features(" ".join(words))[-2:] == [0.125, 0.125]
    assert quality.features(" ")[-2:] == [0.0, 0.0]


def test_gru_gradient():
    model = language.ByteBiGRU(["a", "b", "c"], 3, 1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(0)
    x, y, mask = rng.integers(0, 5, (6, 4)), np.array([0, 1, 2, 1]), np.ones((6, 4))
    _, grad = model.gradients(x, y, mask)
    for k in ("Wf", "Ub", "Vf", "O", "c"):
        at = (1, 0) if model.p[k].ndim == 2 else (0,)
        was, e = model.p[k][at], 1e-3
        model.p[k][at] = was + e
        up = model.gradients(x, y, mask)[0]
        model.p[k][at] = was - e
        down = model.gradients(x, y, mask)[0]
        model.p[k][at] = was
        assert grad[k][at] == pytest.approx((up - down) / (2 * e), abs=2e-3)


def test_every_language_is_learned(spark):
    docs = spark.createDataFrame([(k * 3 + i, f"{w} {w}{i}", f"l{k:02}", "a", 1) for k, w in enumerate(WORDS * 4) for i in range(1 + k % 3)], DOCS)
    model = language.train(docs, docs["doc_id"] >= 0, language.TrainingPlan(steps=2))
    assert model.labels == [f"l{k:02}" for k in range(80)]
    assert {r.lang_pred for r in language.identify(docs, model).select("lid.*").collect()} <= set(model.labels)


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.language_query(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97 and all(0 <= r.score <= 1 for r in got)
    odd = make(spark, [None, "", "123 456", "the and that of the"], lang=None)
    assert [r.lang_pred for r in language.language_query(odd).orderBy("doc_id").collect()] == ["und"] * 4
    assert language.reject_unknown(odd, None, 0.3).count() == 0 and language.language_query(odd.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 200, 255, 256, 257, 900, 2000])
def test_ranges(spark, n):
    """Rows find their range among any number of bounds, ids of all sizes and clustered ones."""
    import bisect

    rng = random.Random(n)
    bounds = sorted({rng.choice([rng.randrange(-(2**63), 2**63), rng.randrange(5000)]) for _ in range(n)})
    places = [rng.choice([rng.randrange(-(2**63), 2**63), rng.randrange(5000), *bounds[:3]]) for _ in range(500)] + [-(2**63), 2**63 - 1]
    df = spark.createDataFrame([(p,) for p in places], "place long")
    got = sketch.in_range(df, F.col("place"), bounds).collect()
    assert sorted((r.place, r.part) for r in got) == sorted((p, bisect.bisect_left(bounds, p)) for p in places)


def test_range_bounds(spark):
    """About as many ranges as asked for, of about equal size, also where ids are clustered."""
    df = spark.range(20_000).select(F.when(F.col("id") < 10_000, F.col("id")).otherwise(F.col("id") * 10**12).alias("place"))
    bounds = sketch.range_bounds(df, F.col("place"), 20_000, sketch.SketchPlan(rows_per_range=100))
    sizes = [r["count"] for r in sketch.in_range(df, F.col("place"), bounds).groupBy("part").count().collect()]
    assert 180 <= len(sizes) <= 200 and max(sizes) < 400 and sum(sizes) == 20_000
    assert sketch.range_bounds(df, F.col("place"), 20_000, sketch.SketchPlan(rows_per_range=20_000)) == []


def test_schedule_streams():
    """A schedule of any length is made in memory that doesn't grow with it."""
    import tracemalloc
    from itertools import islice

    shares = mixing.exact_shares({f"s{k}": k + 1.5 for k in range(40)})
    peaks = []
    for n in (20_000, 200_000):
        tracemalloc.start()
        assert sum(1 for _ in islice(mixing.pfair_slots(shares, dict.fromkeys(shares, 10**9)), n)) == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]


@pytest.mark.parametrize("part", [1, 3, 1024])
def test_schedule_rows(spark, part):
    shares, blocks = mixing.exact_shares({"a": 5.0, "b": 2.0, "c": 0.5}), {"a": 40, "b": 9, "c": 3}
    order = mixing.pfair(shares, blocks)
    got = mixing.schedule(spark, shares, blocks, part).orderBy("mix_source", "mix_part").collect()
    slots = {}
    for r in got:
        assert len(r.mix_slots) == part or r.mix_part == max(x.mix_part for x in got if x.mix_source == r.mix_source)
        slots.setdefault(r.mix_source, []).extend(r.mix_slots)
    assert slots == {k: [t for t, x in enumerate(order) if x == k] for k in shares}
