import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import html_extract
from marginalia.llm.html_extract import STOP_WORDS, Block, BlockRules, blocks_of, extract_pages, labels_of, main_text
from marginalia.llm.queries import URL_RULES
from marginalia.llm.url_templates import Rule, TemplateRules, judge_urls

LONG = "The cat sat on the mat and it was a very good day for all of the people who were there with the cat, as they said to us in the morning when we came by. The weather was fine and it is not to be forgotten."


def test_article_without_chrome():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>
<article class="post"><h1>A &amp; B</h1><p>{LONG}<p>Short&nbsp; one.<br>next<div class="share-bar">Share this</div><aside>Aside</aside><form>Name <input></form></article>
<section id="comments"><p>{LONG}</p></section><div class="cookie-notice">We use cookies</div><footer>&copy; x</footer><script>var a="<p>";</script></body></html>"""
    assert main_text(page) == f"A & B\n{LONG}\nShort one. next"


def test_page_without_article_uses_text_rules():
    page = f"<div class='menu'><a>Home</a></div><div><h2>News</h2><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div><p><a href=x>one</a> <a href=y>two</a> <a>three</a></p>"
    assert main_text(page) == f"News\n{LONG}\nYes.\n{LONG}"


def test_broken_markup():
    assert main_text(None) == main_text("") == ""
    assert main_text("<article><p>x &am") == "x &am"
    assert main_text("<article><p>a<!-- <p>no") == "a"
    assert main_text("<div class=ad>x<article>y</article>") == "y"
    main_text("<div>a" * 20000)
    main_text('<a "' * 20000)
    main_text("<script>" * 20000)


RULES = BlockRules()


def brute_labels(blocks, marked):
    """The two passes by definition, block by block, looking at every other block."""

    def count(b):
        words = re.findall(r"[^\W\d_]+", b.text.lower())
        return (sum(w in STOP_WORDS for w in words), len(words)) if not b.chrome else (0, 0)

    plain = [b for b in blocks if b.links <= RULES.max_links]
    known = sum(count(b)[0] for b in plain) >= 0.03 * sum(count(b)[1] for b in plain)
    share = lambda bs: sum(count(b)[0] for b in bs) / max(1, sum(count(b)[1] for b in bs))

    def one(b, some, inside):
        stops, n = count(b)
        if b.chrome:
            return "bad"
        if b.links > RULES.max_links:
            listed = b.item and sum(x.item and x.box == b.box and x.links > RULES.max_links for x in some) >= 3
            return "ambiguous" if b.heading or inside and not listed else "bad"
        if b.heading or len(b.text) < 70:
            return "ambiguous"
        if (inside or len(b.text) > 200) and (not known or share([b]) >= 0.15):
            return "good"
        sparse = stops + 2 * stops**0.5 + 2 < 0.15 * n
        return "bad" if known and sparse and len(b.text) > 200 and not inside else "ambiguous"

    def judge(some, inside):
        first = [one(b, some, inside) for b in some]
        if "good" not in first and not inside and some:
            usable = [b for b in some if not b.chrome and b.links <= RULES.max_links]
            chars = lambda k: sum(len(b.text) for b in usable if b.box == k)
            box = min({b.box for b in some}, key=lambda k: (-chars(k), k))
            mine = [b for b in usable if b.box == box]
            if mine and chars(box) >= 70 and (chars(box) > 200 or not known or share(mine) >= 0.15):
                first = ["good" if any(b is m for m in mine) else x for b, x in zip(some, first, strict=True)]
        out = []
        for i, b in enumerate(some):
            if first[i] != "ambiguous":
                out.append(first[i])
                continue
            likely = len(b.text) >= 70 and share([b]) >= 0.3
            others = [j for j in range(len(some)) if first[j] != "ambiguous" and (j > i or not b.heading)]
            ranked = sorted((abs(i - j) + 4 * (some[j].box != b.box), first[j] == ("bad" if likely else "good"), first[j]) for j in others)
            out.append(ranked[0][2] if ranked else "good" if inside or likely else "bad")
        return out

    labels = judge(blocks, False)
    held = sum(len(b.text) for b in blocks if b.content and not b.chrome)
    outside = sum(len(b.text) for b, x in zip(blocks, labels, strict=True) if x == "good" and not b.content)
    if marked and any(b.content for b in blocks) and outside <= 4 * held:
        inner = iter(judge([b for b in blocks if b.content], True))
        labels = [next(inner) if b.content else "bad" for b in blocks]
    return [x == "good" for x in labels]


_texts = st.builds(lambda words, n: " ".join(words * n)[:400].strip() or "x", st.lists(st.sampled_from(["the", "of", "stone", "märz", "house", "river", "x1"]), min_size=1, max_size=6), st.sampled_from([1, 3, 8, 20]))
_blocks = st.builds(Block, _texts, st.sampled_from([0.0, 0.0, 0.2, 0.9]), st.sampled_from([False, False, False, True]), st.booleans(), st.sampled_from([False, False, True]), st.integers(0, 3), st.booleans())


@settings(max_examples=600, deadline=None)
@given(st.lists(_blocks, max_size=14), st.booleans())
def test_labels_equal_brute_force(blocks, marked):
    assert labels_of(blocks, marked) == brute_labels(blocks, marked)


def test_densities_decide_inside_and_beside_an_article():
    links = "".join(f"<li><a href=x{i}>Another story of the day {i}</a></li>" for i in range(4))
    page = f"<div><p>{LONG}</p></div><article><h1>T</h1><p>{LONG}</p><h3>Read on</h3><ul>{links}</ul><p>{LONG}</p><p>End.</p></article>"
    assert main_text(page) == f"T\n{LONG}\n{LONG}\nEnd."
    # An article that holds next to nothing of the text is no article, and its blocks are like any other.
    assert main_text(f"<article><p>Teaser</p></article><div><p>{LONG}</p><p>{LONG}</p></div>") == f"Teaser\n{LONG}\n{LONG}"


def test_boxes_without_an_article():
    nav = "<ul>" + "".join(f"<li><a href=x>Page {i}</a></li>" for i in range(5)) + "</ul>"
    page = f"{nav}<div>Buy the new thing now.</div><div><h1>Title here</h1><p>By us</p><p>{LONG}</p><p>Short.</p><p>{LONG}</p><p>Yes.</p></div><footer>(c)</footer>"
    assert main_text(page) == f"Title here\nBy us\n{LONG}\nShort.\n{LONG}\nYes."
    words = " ".join(f"слово{i}" for i in range(60))
    assert main_text(f"{nav}<div><p>{words}</p><p>да</p></div>") == f"{words}\nда"
    assert main_text(f"{nav}<div><p>The first of three is short.</p><p>It is on the way to the second one.</p><p>This is it.</p></div>").count("\n") == 2


@pytest.mark.parametrize("classes", [True, False])
def test_articles_in_plain_boxes(monkeypatch, classes):
    """Pages whose article element became a div, with and without class names: the densities find the same text."""
    import random

    if not classes:
        monkeypatch.setattr(html_extract, "_CHROME_WORDS", frozenset())
    rng = random.Random(3)
    words = sorted(STOP_WORDS)[::9] + [f"{a}{b}" for a in ("lo", "mer", "tan") for b in ("gil", "ra", "sou", "ve", "nist")]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    lost = extra = every = 0
    for _ in range(200):
        body = [sentence(5)] + [sentence(rng.choice((3, 12, 40, 90))) for _ in range(rng.randrange(2, 12))]
        menu = "".join(f"<li><a href='/{i}'>{sentence(1)}</a></li>" for i in range(6))
        page = f"<body><nav><ul>{menu}</ul></nav><div class='ad'>{sentence(8)}</div><div><h1>{body[0]}</h1>" + "".join(f"<p>{x}</p>" for x in body[1:]) + f"</div><footer>{sentence(4)}</footer></body>"
        got = main_text(page).split("\n")
        lost += sum(len(x) for x in body if x not in got)
        extra += sum(len(x) for x in got if x not in body)
        every += sum(map(len, body))
    assert lost < 0.01 * every and extra < 0.01 * every


def test_time_grows_with_the_page():
    def seconds(page):
        start = time.process_time()
        main_text(page)
        return time.process_time() - start

    for piece in ("<svg>", "<head>", "<math><p>a", "<object>x", "<div><p>a</p>", "<!-- a", "<a href='", "</p></div>"):
        small, large = (min(seconds(piece * n) for _ in range(2)) for n in (10_000, 40_000))
        assert large < 12 * small + 0.3, piece


def test_extract_table(spark):
    rows = [(1, "u", "<article><p>a\u00e9</p></article>"), (2, None, None), (2, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", __import__("pyspark").sql.functions.lit("clash"))
    got = sorted((r.page_id, r.text, r.n_chars) for r in extract_pages(df).collect())
    assert got == [(1, "aé", 2), (2, "", 0), (2, "", 0)]
    assert extract_pages(df.limit(0)).count() == 0


def brute(url, rules=URL_RULES):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    raw = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(raw) :]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), raw)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_url_rules_equal_brute_force(spark):
    urls = [None, "", "nourl", "http://A.Net/x", "http://x.net?q=/", "HTTP://NET/", "http://a.b.example.net/en/x?y#z", "http://xnet/", "a://b://c/d", "http://x.example.com/de/1", "http://example.com/de", "https://q.org/fr/2", "https://q.org/fr", "http://É.org/fr/x", "http://h"]
    df = spark.createDataFrame(list(enumerate(urls)) + [(3, urls[3])], "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS rule")
    got = judge_urls(df, URL_RULES).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path, rule, verdict = brute(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict or verdict is None and r.verdict in ("allow", "block")
    assert judge_urls(df.limit(0), URL_RULES).count() == 0


def brute_templates(rows, rules, o):
    """rows: (url, label). Purity and template of each, with dictionaries and recursion."""
    from collections import Counter, defaultdict

    shapes = defaultdict(lambda: [0, 0, 0])
    where = []
    for url, label in rows:
        host, path, _, verdict = brute(url, rules)
        shape = tuple("*" if re.search("[0-9]", x) or len(x) > o.max_segment else x for x in path.split("/")[1:])
        label = {"block": 1, "allow": 0}.get(verdict) if label not in (0, 1) else label
        where.append((host, shape) if host else None)
        if host:
            shapes[host, shape][0] += 1
            shapes[host, shape][1] += label is not None
            shapes[host, shape][2] += label or 0
    template = {}

    def grow(host, prefix, some, level):
        if len(some) == 1:
            template[host, some[0]] = prefix + (("/".join(some[0][level:]),) if len(some[0]) > level else ())
            return
        wide = len({x[level] for x in some if len(x) > level}) > o.max_branches
        deeper = defaultdict(list)
        for x in some:
            if len(x) > level:
                deeper["*" if wide else x[level]].append(x)
            else:
                template[host, x] = prefix
        for key, below in deeper.items():
            grow(host, (*prefix, key), below, level + 1)

    for host in {h for h, _ in shapes}:
        grow(host, (), [s for h, s in shapes if h == host], 0)
    counts = defaultdict(lambda: [0, 0, 0])
    for key, t in template.items():
        counts[key[0], t] = [x + y for x, y in zip(counts[key[0], t], shapes[key], strict=True)]
    branch = {key: key[1] for key in counts}
    while True:
        nodes = defaultdict(lambda: defaultdict(list))
        for (host, t), name in branch.items():
            for level in range(1, len(name) + 1):
                nodes[host, name[: level - 1]][name[level - 1]].append((host, t))
        new = dict(branch)
        for (_, prefix), siblings in nodes.items():
            level = len(prefix) + 1
            total = lambda keys, i: sum(counts[k][i] for k in keys)
            spread = {own: Counter() for own in siblings}
            for own, keys in siblings.items():
                for k in keys:
                    spread[own][branch[k][level:]] += counts[k][0]
            every = sum(spread.values(), Counter())
            keys_all = [k for keys in siblings.values() for k in keys]
            n_all, b_all = total(keys_all, 1), total(keys_all, 2)
            told = sum(total(keys, 1) > 0 for keys in siblings.values())
            for own, keys in siblings.items():
                n, b = total(keys, 1), total(keys, 2)
                overlap = sum(min(c / spread[own].total(), every[x] / every.total()) for x, c in spread[own].items())
                alike = told != 1 if n == 0 else abs(b / n - b_all / n_all) <= o.merge_z * (b_all / n_all * (1 - b_all / n_all) / n) ** 0.5
                if len(siblings) > 1 and overlap >= o.merge_overlap - 1e-9 and alike:
                    for k in keys:
                        new[k] = (*new[k][: level - 1], "~", *new[k][level:])
        if new == branch:
            break
        branch = new
    weight = o.prior_bad + o.prior_good

    def centred(keys, parent):
        keys = list(keys)
        return (sum(counts[k][2] for k in keys) + weight * parent) / (sum(counts[k][1] for k in keys) + weight)

    def passed(keys, part, parent):
        """Through a parent whose labels stand in two parts at least."""
        keys = list(keys)
        return centred(keys, parent) if len({part(k) for k in keys if counts[k][1]}) > 1 else parent

    root = passed(counts, lambda k: ".".join(k[0].split(".")[-2:]), o.prior_bad / weight)
    out = []
    for key in where:
        if key is None:
            out.append((None, None))
            continue
        host, t = key[0], template[key]
        name, domain = branch[host, t], ".".join(host.split(".")[-2:])
        p = passed((k for k in counts if ".".join(k[0].split(".")[-2:]) == domain), lambda k: (*k[1], "")[0], root)
        for level in range(max(1, len(name))):
            inside = [k for k in counts if k[0] == host and branch[k][:level] == name[:level] and (level == 0 or len(branch[k]) > level)]
            # A page at the node itself has no segment there and is no part.
            p = passed([k for k in inside if len(k[1]) > level], lambda k, level=level: k[1][level], p) if len({k[1][level] for k in inside if counts[k][1] and len(k[1]) > level}) < 2 else centred(inside, p)
        p = centred((k for k in counts if k[0] == host and branch[k] == name), p)
        out.append(("/" + "/".join(t), p))
    return out


def test_templates_equal_brute_force(spark):
    import random

    rng = random.Random(9)
    words = ["a", "b", "news", "spam", "c1", "d", "", "en"]
    rows = []
    for _ in range(700):
        host = rng.choice(["a.io", "x.a.io", "b.org", "q.b.org", "c.net", "wide.com"])
        path = "".join("/" + rng.choice(words) for _ in range(rng.randrange(0, 5)))
        if host == "wide.com":
            path = f"/{chr(97 + rng.randrange(20))}{path}"
        label = rng.choice([None, None, None, 0, 7, int("spam" in path)])
        rows.append((f"http://{host}{path}", label))
    rows += [(None, 1), ("nothing", 0), ("http://deep.io" + "/x" * 900, None), ("http://solo.io", 1)]
    rules = [Rule("b.org", "/spam", "block"), Rule("a.io", "/news/", "allow")]
    options = TemplateRules(max_branches=6)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, bad int")
    got = {r.page_id: r for r in judge_urls(df, rules, label_col="bad", options=options).collect()}
    assert len(got) == len(rows)
    for i, (template, purity) in enumerate(brute_templates(rows, rules, options)):
        assert got[i].template == template, rows[i]
        assert (got[i].purity is None) == (purity is None) and (purity is None or abs(got[i].purity - purity) < 1e-9), rows[i]
        if got[i].rule is None:
            assert got[i].verdict == ("block" if (purity or 0) >= options.reject else "allow")


def test_templates_learn_from_labels(spark):
    rows = [(i, f"http://h.io/spam/item-{i}", 1 if i < 40 else None) for i in range(80)] + [(100 + i, f"http://h.io/news/{i}", 0 if i < 40 else None) for i in range(80)]
    rows += [(300 + i, f"http://wide.io/{chr(97 + i)}bc/x", 1) for i in range(20)] + [(400, "http://wide.io/unseen/x", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = {r.page_id: r for r in judge_urls(df, [], label_col="bad").collect()}
    assert {got[i].verdict for i in range(80)} == {"block"} and {got[100 + i].verdict for i in range(80)} == {"allow"}
    assert got[0].template == "/spam/*" and got[400].template == "/*/x" and got[400].verdict == "block"


def test_method_judges_by_template_not_by_domain(spark):
    """Labels of one path say nothing of a host's others; those of two or more do."""
    urls = [f"http://{host}.io/{top}/{i}" for host in ("bad", "good", "worse") for top in ("de", "en") for i in range(20)] + [f"http://worse.io/fr/{i}" for i in range(20)]
    urls += [f"http://both.io/{top}/{i}" for top in ("spam", "spam2", "news", "en") for i in range(20)] + ["http://bad.io", "http://other.io/en/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [Rule("bad.io", "/de/", "block"), Rule("good.io", "/de/", "allow"), Rule("worse.io", "/de/", "block"), Rule("worse.io", "/fr/", "block"), Rule("both.io", "/spam", "block"), Rule("both.io", "/news/", "allow")]
    got = {urls[r.page_id]: r for r in judge_urls(df, rules).collect()}
    verdicts = lambda start: {got[u].verdict for u in urls if u.startswith(start)}
    assert verdicts("http://worse.io/en/") == {"block"} and got["http://worse.io/en/1"].purity > 0.8
    # All labels together are bad here by more than half; a host's one labelled path adds nothing to that for its others.
    assert got["http://bad.io/en/1"].purity == got["http://bad.io"].purity == got["http://other.io/en/1"].purity == got["http://good.io/en/1"].purity
    assert verdicts("http://good.io/de/") == {"allow"}


def test_verdicts_differ_within_a_host(spark):
    """By templates with labels of both kinds; without the tree, the host's purity would judge all alike."""
    rows = [(k, f"http://h.io/{top}/{sub}/{k}", (1 if top == "spam" else 0) if k % 4 else None) for k, (top, sub) in enumerate((t, x) for t in ("spam", "news") for x in ("a", "b") for _ in range(40))]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string, bad int"), [], label_col="bad").collect()
    unlabelled = {r.page_id: r.verdict for r in got if r.page_id % 4 == 0}
    assert {v for k, v in unlabelled.items() if k < 80} == {"block"} and {v for k, v in unlabelled.items() if k >= 80} == {"allow"}


def test_deep_paths_take_no_more_steps(spark):
    """A hundred segments in common cost about what four do."""
    import time

    took = {}
    for depth in (4, 4, 100):
        urls = [f"http://trap{h}.io{'/a/b' * (depth // 2)}/{leaf}" for h in range(3) for leaf in ("x", "y")] + [f"http://trap.io{'/a' * k}" for k in range(depth)]
        df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
        start = time.perf_counter()
        got = {urls[r.page_id]: r.template for r in judge_urls(df, []).collect()}
        took[depth] = time.perf_counter() - start
        assert got[f"http://trap0.io{'/a/b' * (depth // 2)}/x"] == "/a/b" * (depth // 2) + "/x"
    assert took[100] < 2 * took[4] + 2, took
