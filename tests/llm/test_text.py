import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from hyperloom.llm import classifier, html, language, pii, queries, rules
from hyperloom.llm.html_tree import kept_blocks, read
from pyspark.sql import functions as F

from .common import SCHEMA, awkward, empty

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></ul></nav><div class="ad-box">Buy</div>
<article><header><h1>Title &amp; more</h1><p>by me</p></header><p>One <b>bo</b>ld<br>line&nbsp;x <!-- c -->y<p>Two 5 < 6
<div class="cookie notice">We use</div><form>f<input></form><section id="comments"><article>first!</article></section></article>
<aside>side</aside><footer>&copy; foot</footer></body></html>"""


@pytest.mark.parametrize(
    "page,want",
    [
        (PAGE, "Title & more One bold line x y Two 5 < 6"), ("", ""), ("plain &lt;b&gt; text", "plain <b> text"), ("<p>a<p>b</p></p>c", "a b c"), ("<!-- x", ""), ("<script>x", ""), ("a<", "a<"),
        ('<div title="a>b">z</div>', "z"), ("<nav>a</nav><div id=main>b</div>", "b"), ("<main><p>x</p></main><p>y</p>", "x"), ("<p hidden>a</p><p>b</p>", "b"), ("<ul><li>a<li>b</ul>", "a b"),
    ],
)
def test_main_text(page, want):
    assert " ".join(kept_blocks(read(page), ())) == want


@pytest.mark.parametrize(
    "page,want",
    [
        ('<article><div class="entry-header"><h1>Title</h1></div><p>x</article>', "Title x"), ('<body class="content-with-sidebar"><p>x</p></body>', "x"), ('<main><div class="social-history">a</div>b</main>', "a b"),
        ('<div class="site-header">a</div><p>b</p><div class="ad-slot-2">c</div><div class="sidebar left">d</div><div id="comments">e</div><div class="main-nav">f</div>', "b"),
        ('<p class="noticed adverse headers-up">a</p><p class="share-buttons">b</p>', "a"),
    ],
)
def test_classes_name_parts_as_a_whole(page, want):
    """A class tells of a menu or the like only if nothing but words that frame it stand beside."""
    assert " ".join(kept_blocks(read(page), ())) == want


def test_templates_equal_brute_force(spark):
    """Boxes that are on four different pages of a host go, others stay, whatever the host's size; without counting none would go."""
    random.seed(9)
    rows, own, want = [], {}, {}
    boxes = [f"<div><span>Box {b} of the site</span></div>" for b in range(30)]
    for i in range(200):
        host, has = f"h{random.randrange(6)}", random.sample(range(30), 2)
        own[i] = (host, has, f"Own words of page {i}")
        rows.append((i, f"https://{host}.example/{i}", f"<body>{boxes[has[0]]}<div><p>{own[i][2]}</p></div>{boxes[has[1]]}</body>"))
    for i, (host, has, text) in own.items():
        on = [sum(b in h and g == host for g, h, _ in own.values()) for b in has]
        parts = [f"Box {has[0]} of the site", text, f"Box {has[1]} of the site"]
        want[i] = " ".join(t for t, n in zip(parts, (on[0], 0, on[1])) if n < html.MIN_PAGES)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract(df).collect()} == want
    assert sum(len(t) for t in want.values()) < sum(r.n_chars for r in html.extract(df, min_pages=1000).collect())


def test_deep_and_broken_pages_take_time_in_proportion():
    for page in ("<div>" * 20_000 + "x", "<i>" * 50_000 + "x" + "</b>" * 50_000, '<a "' * 20_000, "<p>a &amp; b <b>" * 10_000):
        read(page)


@pytest.mark.parametrize("most", [1000, 0])
def test_templates_go(spark, most):
    box = "<div><span>Follow us on all channels</span></div>"
    rows = [(i, f"http://h.example.com/{i}", f"<body><div><p>Own text {i} of this page</p><p>shared words</p>{box}</div></body>") for i in range(8)]
    rows += [(i, "http://other.example.com/", f"<body><p>Copy</p>{box}</body>") for i in range(8, 14)] + [(20, None, None), (None, "x", "<p>a")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("keys", F.lit(2))
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(df, most=most).collect()}
    assert len(got) == len(rows)
    for i in range(8):
        assert got[i][0] == f"Own text {i} of this page"
    assert got[8][0] == "Copy Follow us on all channels" and got[20] == ("", 0) and got[None] == ("a", 1)
    inside = spark.createDataFrame([(i, "http://h.example.com/", f"<article><p>Own {i}</p><p>Shared sentence</p><div>{box}</div></article>") for i in range(8)], "page_id long, url string, html string")
    assert {r.text for r in html.extract(inside, most=most).collect()} == {f"Own {i} Shared sentence" for i in range(8)}
    assert html.extract(df.where("page_id = -1"), most=most).count() == 0


def test_templates_of_a_section_go_on_a_large_host(spark):
    """A section's menu, advert and notice in neutral markup, on few of the host's pages; a copied page's text stays."""
    boxes = [f"<div class='x{s}'><span>Offer {s} ends soon</span></div><div><a href='/{s}'>Part {s}</a> <i>of section {s} here</i></div>" for s in range(60)]
    rows = [(i, f"http://h.example.com/{i}", f"<body><div><p>Own text {i} of this page</p>{boxes[i % 60]}</div></body>") for i in range(360)]
    rows += [(1000 + i, f"http://h.example.com/copy{i}", "<body><div><p>Copied text</p><p>of one page</p></div></body>") for i in range(9)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Own text {i} of this page" if i < 1000 else "Copied text of one page" for i, *_ in rows}


def repeats(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})


def test_rules(spark):
    random.seed(4)
    made = [(i, " ".join(random.choice("ab") for _ in range(random.randint(0, 30))), "en", "s", 0) for i in range(100, 150)]
    df = awkward(spark).select("doc_id", "text").union(spark.createDataFrame(made, SCHEMA).select("doc_id", "text"))
    df = df.union(spark.createDataFrame([(200, "l1 x\n\nl1 x\n \nl1 x\r\nl2 #*$%&|<>", "", "", 0)], SCHEMA).select("doc_id", "text"))
    got = {(r.doc_id, r.n_words): r for r in rules.ledger(df.where("length(text) < 10000 OR text IS NULL")).collect()}
    for r in df.where("length(text) < 10000 OR text IS NULL").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        lines = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        g = got[r.doc_id, len(words)]
        assert (g.word_chars, g.n_symbols, g.n_dup_lines) == (sum(map(len, words)), len(re.findall("[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)))
        assert g.n_repeat_words == repeats(words)
    assert rules.ledger(empty(spark)).count() == 0 and len(rules.ledger(awkward(spark)).collect()) == 14
    long = "word another thing " * 4000 + "and a last line\n" * 50
    got = rules.ledger(spark.createDataFrame([(1, long, "", "", 0)], SCHEMA)).first()
    words, lines = long.split(), [x for x in long.split("\n") if x]
    twice = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if twice[g] > 1 for k in range(3)}
    assert (got.n_words, got.n_repeat_words, got.n_dup_lines) == (len(words), len(covered), len(lines) - len(set(lines)))
    entries = rules.ledger(df)
    report = {r.rule: (r.fails, r.only) for r in rules.ablations(entries).collect()}
    assert set(report) == set(rules.RULES)
    assert report["few_words"][0] == entries.where("n_words < 50").count()
    assert report["few_words"][1] == entries.where(f"failures = {rules.mask(['few_words'])}").count()


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (2 * d > 9) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_spans(text):
    out = []
    for i, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), i, m.end()))
    return sorted(out)


def test_personal_data(spark):
    random.seed(3)
    parts = ["1", "2", "5", "55", "256", ".", "@", "a", "b-c", "_", "+", " ", "-", "(", "é", "4242 4242 4242 4242", "😀", "%", "x@y.zz", "\n"]
    rows = [(1000 + i, "".join(random.choice(parts) for _ in range(random.randint(1, 60)))) for i in range(800)] + [(1, "a@b.cc " * 300)]
    df = awkward(spark).select("doc_id", "text", "row").unionByName(spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)))
    want = {}
    for r in df.collect():
        want.setdefault(r.doc_id, set()).add(str(plain_spans(r.text)))
    got = pii.sanitisation(df).collect()
    assert len(got) == df.count()
    for r in got:
        assert str([(s.start, s.kind, s["end"]) for s in r.base]) in want[r.doc_id]
    assert pii.sanitisation(empty(spark)).count() == 0


def test_personal_data_query_counts_and_hash(spark, tmp_path):
    texts = [None, "", "a@b.cc", "10.0.0.1 a@b.cc x@y.zz", "+1 (555) 123-4567 4242 4242 4242 4242", "4242 4242 4242 4242 1.2.3.4 1.2.3.256 +1 (555) 123-4567 +2 (555) 123-4567 a@b.cc", "😀 a@b.cc " * 3]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op7_pii(spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, text in enumerate(texts):
        spans, r = plain_spans(text), got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, k, _ in spans) for kind in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def test_terms_that_reveal(spark):
    names = ["ann", "bea", "cat", "dan", "eva", "fay"]
    rows = [(i, f"{names[i]} wrote: Zorblax uses agent7@corp.example often in {names[-1 - i]} town") for i in range(6)]
    rows += [(100 + i, f"often we wrote of the town {i}") for i in range(40)] + [(200 + i, "copied Unique words near copy@corp.example here") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [rows[i][1][s.start : s["end"]] for i in (j for j, x in enumerate(rows) if x[0] == r.doc_id) for s in r.spans] for r in pii.sanitisation(df, min_bits=3.0).collect()}
    assert all({"agent7@corp.example", "Zorblax"} <= set(got[i]) and "often" not in got[i] for i in range(6))
    assert all(got[100 + i] == [] for i in range(40)) and all(got[200 + i] == ["copy@corp.example"] for i in range(20))
    spans = pii.sanitisation(df, min_bits=3.0).join(df, "doc_id").where("doc_id = 0").select(pii.generalised(F.col("text"), F.col("spans")).alias("t")).first().t
    assert spans.startswith("ann wrote: [TERM]") and "[EMAIL]" in spans and "agent7" not in spans


def revealed(spark, rows):
    """The terms removed from each text, by brute force and by the query."""
    texts = dict(rows)
    mails = {i: {m[0].lower() for m in re.finditer(PLAIN["email"], t)} for i, t in rows}
    words = {i: set(re.findall(r"[^\W\d_]{3,}", re.sub(PLAIN["email"], " ", t).lower())) for i, t in rows}
    with_term = {w: [i for i in words if w in words[i]] for w in set().union(*words.values())}
    told = set()
    for mail in set().union(*mails.values()):
        has = [i for i in mails if mail in mails[i]]
        for w, at in with_term.items():
            both = [i for i in at if i in has]
            if len({texts[i] for i in both}) >= 3 and len(both) / len(at) >= 0.5 and len(both) / len(at) * len(rows) / len(has) >= 16:
                told.add(w)
    want = {}
    for i, t in rows:
        hidden = [m.span() for m in re.finditer(PLAIN["email"], t)]
        want[i] = [m[0] for m in re.finditer(r"[^\W\d_]{3,}", t) if m[0].lower() in told and not any(m.start() < b and a < m.end() for a, b in hidden)]
    got = {r.doc_id: [texts[r.doc_id][s.start : s["end"]] for s in r.spans if s.kind == len(pii.KINDS)] for r in pii.sanitisation(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return got, want


def test_terms_that_reveal_from_afar(spark):
    """Far from the address, at each mention, and in a text without the address."""
    random.seed(9)
    common = [f"{a}{b}ing" for a in "bcdfg" for b in ("al", "er", "in", "ot")]
    prose = lambda n: " ".join(random.choices(common, k=n))
    rows = [(i, f"Zorblax {prose(60)} agent7@corp.example {prose(60)} Zorblax {prose(5)} zorblax end") for i in range(6)]
    rows += [(10, f"{prose(10)} Zorblax {prose(10)}")] + [(100 + i, prose(40)) for i in range(150)]
    got, want = revealed(spark, rows)
    assert got == want and got[10] == ["Zorblax"]
    assert all([w for w in got[i] if w.lower() == "zorblax"] == ["Zorblax", "Zorblax", "zorblax"] for i in range(6))


def test_terms_that_reveal_in_one_wording(spark):
    """One contact line in different documents is evidence; in copies of one document it isn't."""
    random.seed(10)
    common = [f"{a}{b}ing" for a in "bcdfg" for b in ("al", "er", "in", "ot")]
    prose = lambda n: " ".join(random.choices(common, k=n))
    rows = [(i, f"{prose(30)} please write to Quixley at desk@corp.example thanks again {prose(30)}") for i in range(8)]
    copied = f"{prose(30)} write to Unique Person at copy@corp.example here"
    rows += [(50 + i, copied) for i in range(8)] + [(100 + i, prose(40)) for i in range(200)]
    got, want = revealed(spark, rows)
    assert got == want and all("Quixley" in got[i] for i in range(8)) and not any(got[50 + i] for i in range(8))


def test_classifier(spark):
    random.seed(5)
    rows, labels = [], []
    for i in range(400):
        good = random.random() < 0.6
        words = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 9))) for _ in range(random.randint(5, 90))]
        rows.append((i, " ".join(words) + "." if good else " ".join(w + "***" for w in words), "en", "s", 0))
        labels.append((i, int(good)))
    df, y = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    got = classifier.scores(df, y).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 400 and {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.predicted == labels[r.doc_id][1] for r in held) > 0.95 * len(held) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    hidden = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in labels], "doc_id long, quality int")
    assert sorted((r.doc_id, r.score) for r in classifier.scores(df, hidden).collect()) == sorted((r.doc_id, r.score) for r in got)
    odd = awkward(spark)
    for some in (y, y.where("doc_id < 0"), y.withColumn("quality", F.lit(None).cast("int")), y.withColumn("quality", F.lit(1))):
        assert classifier.scores(odd, some).where("score BETWEEN 0 AND 1").count() == 14
    assert classifier.scores(empty(spark), y).count() == 0


def test_isotonic():
    import numpy as np

    at, value = classifier.isotonic(np.array([3.0, 1, 2, 4]), np.array([0, 0, 1, 1]))
    assert value == [0, 0.5, 1] and at == [1, 2.5, 4]


def test_language(spark):
    words = {"en": "the of and this that with house water".split(), "de": "der die und nicht mit haus wasser strasse".split()}
    random.seed(6)
    rows = [(i, " ".join(random.choice(words[x]) for _ in range(12)), x, f"s{i % 3}", 0) for i in range(200) for x in [random.choice(["en", "de"])]]
    wrong = [(500, "der die und nicht mit haus wasser strasse der die und nicht", "en", "s0", 0), (501, "日本語のテキストはここにあります。" * 20, None, "s0", 0), (502, "*** !!! ???", "en", "s0", 0), (503, None, None, None, 0), (504, "the house of water", None, None, 0)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows + wrong, SCHEMA)).collect()}
    assert all(got[i].lang == x and got[i].kept for i, _, x, _, _ in rows)
    assert got[500].text_lang == "de" and got[501].lang == got[502].lang == got[503].lang == "und" and not got[501].kept and got[504].lang == "en"
    assert language.identify(empty(spark)).count() == 0 and language.identify(awkward(spark)).count() == 14
    none = language.identify(spark.createDataFrame([(1, "abc", None, None, 0)], SCHEMA)).first()
    assert none.lang == "und" and not none.kept


def test_language_of_a_small_share(spark):
    """0.1 % of the rows, and a hot source in another language."""
    words = {"en": "the of and this that with house water".split(), "de": "der die und nicht mit haus wasser strasse".split(), "fi": "ja ei talo vesi katu kanssa joka hyvin".split()}
    random.seed(7)
    text = lambda x: " ".join(random.choices(words[x], k=12))
    rows = [(i, text(x), x, "hot" if x == "en" else "s", 0) for i in range(20_000) for x in ["fi" if i % 1000 == 0 else "de" if i % 50 == 1 else "en"]]
    rows += [(30_000 + i, text("fi"), None, "s", 0) for i in range(5)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].lang == (x or "fi") and got[i].kept for i, _, x, _, _ in rows)
    assert len(got) == len(rows)


def test_classifier_solves_the_normal_equations(spark):
    """The weights are those of one ridge regression over all fitted rows at once."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, len(classifier.statistics())))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(float)
    rows = [([float(v) for v in a], float(b), int(i % 4 == 0)) for i, (a, b) in enumerate(zip(x, y))]
    model = classifier.fit(spark.createDataFrame(rows, "x array<double>, y double, part int").repartition(5))
    fitted = np.arange(300) % 4 != 0
    z = model.features(x[fitted])
    penalty = classifier.RIDGE * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9
    np.testing.assert_allclose(model.weights, np.linalg.solve(z.T @ z + penalty, z.T @ y[fitted]), rtol=1e-6, atol=1e-8)
    few = classifier.fit(spark.createDataFrame(rows, "x array<double>, y double, part int"), calibrate=20)
    assert 1 <= len(few.levels[0]) <= 40 and (np.diff(model.levels[1]) > 0).all()
    distance = ((x[:40, None] - x[None, :40]) ** 2 / model.scale**2).sum(-1)
    kernel = np.exp(-distance / (2 * classifier.WIDTH**2))
    near = model.features(x[:40])[:, :-1]
    assert abs(near @ near.T - kernel).mean() < 0.06


def test_language_posterior_equals_brute_force(spark):
    """Text, declaration and smoothed host prior multiplied, a wrong declaration and a host of one language among them."""
    random.seed(3)
    words = {"en": "the of and to in that is was he for it with".split(), "de": "der die und in den von zu das mit sich".split(), "fr": "le la les de et que des un une dans".split()}
    rows = []
    for i in range(240):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, " ".join(random.choices(words[lang], k=random.randint(2, 12))), lang, f"{lang}host" if i % 2 else "mixed", 0))
    rows += [(900, " ".join(words["de"] * 3), "fr", "dehost", 0), (901, "in", None, "dehost", 0), (902, "in", None, "enhost", 0), (903, "in", "xx", None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    url = F.concat(F.lit("http://"), F.coalesce("source", F.lit("none")), F.when(F.col("source") == "mixed", ".org").otherwise(".de"))
    got = {r.doc_id: r for r in language.identify(df.withColumn("address", url), url="address").collect()}
    prepared = language._prepared(df.withColumn("address", url), "lang", F.col("source"), "address")
    names, model = language.fit(prepared)
    n, told = len(names), {r.doc_id: r for r in prepared.collect()}
    likely = {i: model.likely(t.text.encode()) * language.TEMPER for i, t in told.items()}
    vote = {i: int(x.argmax()) for i, x in likely.items() if x.max() > np.log(language.OTHER)}
    smooth = language.SMOOTH

    def share(ids, parent):
        c = np.bincount([vote[i] for i in ids if i in vote], minlength=n)
        return (c + smooth * parent) / (c.sum() + smooth)

    whole = np.bincount(list(vote.values()), minlength=n)
    whole = (whole + 1) / (whole.sum() + n)
    by_suffix, by_host = defaultdict(list), defaultdict(list)
    for i, t in told.items():
        by_suffix[t.suffix].append(i)
        by_host[t.host, t.suffix].append(i)
    prior = {k: share(v, share(by_suffix[k[1]], whole)) for k, v in by_host.items()}
    said = Counter((t.declared, vote[i]) for i, t in told.items() if t.declared in names and i in vote)
    for i, t in told.items():
        logs = likely[i] + np.log(prior[t.host, t.suffix])
        if t.declared in names:
            for k in range(n):
                given = smooth + sum(said[d, k] for d in names)
                logs[k] += np.log((said[t.declared, k] + smooth * (0.9 if t.declared == names[k] else 0.1 / (n - 1))) / given)
        logs = np.append(logs, np.log(language.OTHER) - np.log(n))
        p = np.exp(logs - logs.max())
        assert got[i].lang == [*names, language.UNKNOWN][int(p.argmax())]
        assert abs(got[i].posterior - p.max() / p.sum()) < 1e-9
    assert got[900].lang == "de" and got[901].lang == "de"


def test_disclosures_equal_brute_force(spark):
    """Shares and bits of all pairs of term and entity, counted directly."""
    random.seed(12)
    names, people = [f"Name{chr(97 + i)}x" for i in range(8)], [f"p{i}@mail.example" for i in range(8)]
    texts = []
    for i in range(400):
        k = random.randrange(40)
        parts = random.choices("alpha beta gamma delta common words".split(), k=5)
        if k < 8:
            parts += [people[k]] if random.random() < 0.8 else []
            parts += [names[k]] if random.random() < 0.7 else []
        texts.append(" ".join(random.sample(parts, len(parts))))
    texts += [texts[0]] * 5 + [None]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    found = pii.stored(pii.entities(df), "entities")
    got = {(r.term, r.entity): (r.share, r.bits) for r in pii.disclosures(found).collect()}
    hashed = {r.t: r.h for r in spark.createDataFrame([(w,) for w in {x.lower() for t in texts for x in re.findall(r"[A-Za-z]{3,}", re.sub(PLAIN["email"], " ", t or ""))}], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    codes = {r.v: r.h for r in spark.createDataFrame([(v,) for v in people], "v string").select("v", F.xxhash64(F.lit(0), "v").alias("h")).collect()}
    want = {}
    with_term, with_entity = defaultdict(set), defaultdict(set)
    for i, t in enumerate(texts):
        for w in set(re.findall(r"[a-z]{3,}", re.sub(PLAIN["email"], " ", t or "").lower())):
            with_term[w].add(i)
        for e in people:
            if e in (t or "").split():
                with_entity[e].add(i)
    for w, a in with_term.items():
        for e, b in with_entity.items():
            both = a & b
            share = len(both) / len(a)
            bits = np.log2(share * len(texts) / len(b)) if both else -1
            if len({texts[i] for i in both}) >= pii.MIN_TEXTS and share >= pii.MIN_SHARE and bits >= pii.MIN_BITS:
                want[hashed[w], codes[e]] = (share, bits)
    assert set(got) == set(want) and len(want) >= 3
    assert all(abs(got[k][0] - want[k][0]) < 1e-12 and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_terms_within_emails_stay_with_them(spark):
    """Spans that overlap taken ones are told by cells: against brute force, with long ones and cells' borders."""
    random.seed(2)
    spans = [(r, s, s + random.randint(1, 30)) for r in range(4) for s in random.sample(range(3000), 60)]
    taken = [(r, s, s + random.choice([3, 20, 700])) for r in range(3) for s in range(random.randint(0, 50), 3000, 900)]
    schema = "row long, start int, end int"
    got = pii._clear(spark.createDataFrame(spans, schema), spark.createDataFrame(taken, schema)).collect()
    assert sorted(map(tuple, got)) == sorted(x for x in spans if not any(r == x[0] and s < x[2] and x[1] < e for r, s, e in taken))
    texts = [f"Zorblax writes from zorblax@corp.example about thing {i}" for i in range(4)] + ["nothing here at all"] * 200
    df = spark.createDataFrame([(i, f"{t} {i}", None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    r = pii.sanitisation(df).where("doc_id = 1").first()
    terms = [(x.start, x.end) for x in r.spans if x.kind == len(pii.KINDS)]
    assert (0, 7) in terms and not any(20 <= s < 40 for s, _ in terms)
