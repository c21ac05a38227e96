"""License scans, SimHash, toxicity and HTML extraction against plain versions."""

import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import licenses, simhash, toxicity
from larder.llm.components import components
from larder.llm.html_text import extract_text, main_blocks

from llm_fixtures import LONG, rows_of

# ---------------------------------------------------------------- licenses


def test_license_words_and_places_match_a_plain_scan():
    scanner = licenses.Scanner(licenses.rules())
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for text in ("MIT License MIT license", "The GNU General Public License, Apache-License", "été MIT License mit  license!", "", "submit license", "mit license_x"):
        words, n = licenses.words_of(text)
        plain = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = sorted((k, label) for p, label in phrases.items() for k in range(len(plain)) if plain[k : k + len(p.split())] == p.split())
        assert n == len(plain)
        assert sorted((a, scanner.rules[k].label) for k, a, _ in scanner.hits(words) if scanner.rules[k].base) == places


def test_license_suppression():
    scanner = licenses.Scanner(licenses.rules())
    kept = scanner.resolve(scanner.hits(licenses.words_of("Licensed under the Apache License, Version 2.0. See CC BY-NC 4.0.")[0]))
    assert [(scanner.rules[k].label, a, b) for k, a, b in kept] == [("apache-2.0", 0, 7), ("cc-by-nc-4.0", 8, 13)]
    assert len(licenses.rules()) > 300


def test_license_edges(edge_docs, no_docs):
    got = {(r[0], r[1]): r for r in rows_of(licenses.scan_licenses(edge_docs))}
    assert licenses.scan_licenses(edge_docs).count() == edge_docs.count()
    assert got[(3, 0)][2:] == ([], []) and got[(4, 0)][2:] == ([], [])
    assert len(got[(6, 8 * 6000)][2]) == 6000
    assert rows_of(licenses.scan_licenses(no_docs)) == []


# ---------------------------------------------------------------- SimHash


def plain_fingerprint(text, words=4):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB é\n\x0b\x1c,", max_size=60))
def test_fingerprints_match_a_plain_version(text):
    assert int(simhash.text_fingerprints([text])[0]) == plain_fingerprint(text)


def clusters(rng, centres, members, flips):
    out = set()
    for c in rng.integers(0, 2**63, centres, dtype=np.uint64):
        for _ in range(int(rng.integers(1, members))):
            x = int(c) * 2
            for k in rng.integers(0, 64, int(rng.integers(0, flips))):
                x ^= 1 << int(k)
            out.add(x & (2**64 - 1))
    return np.array(sorted(out), np.uint64)


def plain_roots(near):
    root = np.arange(len(near))
    while True:
        new = np.array([root[near[i]].min() for i in range(len(near))])
        if (new == root).all():
            return root
        root = new


@pytest.mark.parametrize("radius", [0, 1, 4, 9, 20])
@pytest.mark.parametrize("n_blocks", [1, 6])
def test_bit_sliced_blocks_match_brute_force(radius, n_blocks):
    rng = np.random.default_rng(radius)
    fps = clusters(rng, 30, 60, 9)
    block = np.unique(np.sort(rng.integers(0, n_blocks, len(fps))), return_inverse=True)[1]
    near = (np.bitwise_count(fps[:, None] ^ fps[None]) <= radius) & (block[:, None] == block[None])
    assert (simhash.block_roots(fps, block, radius) == plain_roots(near)).all()


@pytest.mark.parametrize("block_rows, tile_rows", [(512, 2048), (1, 4)])
def test_links_give_the_brute_force_components(spark, block_rows, tile_rows):
    """Every number of bands and any tiling connect the same fingerprints."""
    fps = clusters(np.random.default_rng(5), 25, 40, 9)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = simhash.near_links(df, len(fps), 4, block_rows, tile_rows)
    found = dict(rows_of(components(links)))
    roots = plain_roots(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4)
    groups = {}
    for x, r in zip(fps.view(np.int64).tolist(), roots.tolist(), strict=True):
        groups.setdefault(r, []).append(x)
    for members in groups.values():
        assert {found.get(x, x) for x in members} == {min(members)}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(1, 6)] + [(9, 9), (50, 51), (51, 50)]
    got = dict(rows_of(components(spark.createDataFrame(edges, "a long, b long"))))
    assert {got[k] for k in range(100, 141)} == {100} and {got[k] for k in (1, 2, 3, 4, 5, 7)} == {1}
    assert got[50] == got[51] == 50 and 9 not in got
    assert rows_of(components(spark.createDataFrame([], "a long, b long"))) == []


def test_simhash_edges(edge_docs, no_docs):
    got = rows_of(simhash.simhash_groups(edge_docs))
    assert len(got) == edge_docs.count()
    by = {}
    for doc_id, fp, component in got:
        by.setdefault(doc_id, set()).add((fp, component))
    assert by[2] == by[1] and {c for _, c in by[1]} == {1}
    assert by[3] == by[4] == by[5] == {("0" * 16, 3)} and ("0" * 16, 3) in by[None]
    assert rows_of(simhash.simhash_groups(no_docs)) == []


def test_near_duplicates_match_exact_jaccard(spark, edge_docs, no_docs):
    rng = np.random.default_rng(3)
    texts = []
    for base in range(12):
        words = [f"w{base}x{k}" for k in rng.integers(0, 400, 200)]
        texts.append(words)
        texts.append([*words[:100], "other", *words[101:]])  # similarity about 0.95
        texts.append([w if k % 4 else f"n{base}y{k}" for k, w in enumerate(words)])  # far below 0.8
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    kept = sorted(r[0] for r in rows_of(simhash.drop_near_duplicates(docs)))
    assert kept == [k for k in range(36) if k % 3 != 1]
    left = simhash.drop_near_duplicates(edge_docs)
    assert left.columns == edge_docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == [(False, 1), (False, 3), (False, 6), (False, 7), (True, 0)]
    assert rows_of(simhash.drop_near_duplicates(no_docs)) == []


def test_tiled_near_duplicates_agree(spark):
    docs = spark.createDataFrame([(k, " ".join(f"t{j if j != k else -k}" for j in range(150))) for k in range(60)], "doc_id long, text string")
    assert [r[0] for r in rows_of(simhash.drop_near_duplicates(docs, tile_rows=8))] == [0]


def spellings(parsed):
    """Texts that a parsed pattern matches: every alternative, optional parts with and without, other repeats at their least."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "IN":
            more = [chr(x) if str(kind) == "LITERAL" else "x" for kind, x in arg]
        elif name == "ANY":
            more = ["x"]
        elif name == "BRANCH":
            more = [x for branch in arg[1] for x in spellings(branch)]
        elif name == "SUBPATTERN":
            more = spellings(arg[-1])
        else:
            assert name in ("MAX_REPEAT", "MIN_REPEAT")
            inner = spellings(arg[2])
            more = [x * arg[0] for x in inner] + (inner if arg[:2] == (0, 1) else [])
        out = [a + b for a in out for b in dict.fromkeys(more)]
    return out


def test_every_alternative_of_a_license_rule_holds_its_keyword():
    from re import _parser

    for r in licenses.rules():
        if r.priority in (3, 4):  # a name after a verb: the name is tested by itself
            continue
        for text in spellings(_parser.parse(r.pattern)):
            words = f" {text} ".encode()
            assert r.keyword.encode() in words if r.keyword else any(x in words for x in licenses.ANY_NAME), (r, text)
    scanner = licenses.Scanner(licenses.rules())
    for text, label in (("released under Creative Commons Zero 1.0 Universal", "cc0-1.0"), ("may not be copied without the prior written consent of us", "proprietary")):
        assert label in {scanner.rules[k].label for k, _, _ in scanner.resolve(scanner.hits(licenses.words_of(text)[0]))}


def test_near_duplicates_are_exact_around_the_limit(spark):
    """A text and its beginning: sizes in shingles, so the similarity is their quotient; short texts included."""
    sizes = [(100, 75), (100, 79), (100, 80), (100, 82), (400, 300), (400, 316), (400, 320), (400, 328), (81, 64), (80, 64), (79, 63), (78, 63), (5, 4), (4, 3), (10, 8), (9, 7), (15, 12), (14, 11), (1, 1), (2, 1)]
    docs, kept = [], []
    for k in range(6):
        for n, m in sizes:
            words = [f"p{k}n{n}m{m}w{j}" for j in range(n + 4)]
            docs += [(len(docs), " ".join(words)), (len(docs) + 1, " ".join(words[: m + 4]))]
            kept += [len(docs) - 2] + [len(docs) - 1] * (m / n < 0.8)
    # a chain of which each link holds, and one whose middle link does not
    chain = [[f"c{j}" for j in range(a, a + 104)] for a in (0, 10, 20, 32)]
    docs += [(len(docs) + k, " ".join(words)) for k, words in enumerate(chain)]
    kept += [len(docs) - 4, len(docs) - 1]
    got = simhash.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r[0] for r in rows_of(got)) == kept


# ---------------------------------------------------------------- toxicity

CLEAN = ["the river runs past the old mill", "bread rises slowly in the morning", "a quiet street near the station", "she reads the long letter again"]
BAD = ["you are a snarfle and a grolt", "what a blimpet thing to say"]


def toxic_table(n):
    rng = np.random.default_rng(1)
    texts, toxic = [], []
    for k in range(n):
        parts = [CLEAN[i] for i in rng.integers(0, 4, int(rng.integers(1, 9)))]
        if k % 4 == 0:
            parts.insert(int(rng.integers(0, len(parts) + 1)), BAD[k % 2 if k % 8 else 1])
        texts.append(". ".join(parts) + ".")
        toxic.append(int(k % 4 == 0))
    return texts, np.array(toxic)


def test_toxicity_learns_from_documents_and_finds_sentences():
    texts, toxic = toxic_table(240)
    model = toxicity.learn(texts[:160], toxic[:160], np.ones(160))
    weights = toxicity.WordWeights(model)
    scores = [toxicity.noisy_or(toxicity.sentence_chances(t, weights)[0]) for t in texts[160:]]
    assert ((np.array(scores) >= 0.5) == (toxic[160:] == 1)).mean() > 0.97
    text = "Été calme. What a BLIMPET thing to say! Bread rises"
    chances, numbers = toxicity.sentence_chances(text, weights)
    worst = numbers[int(chances.argmax())]
    (start, end), = toxicity.sentence_spans(text, [worst])
    assert text[start:end] == "What a BLIMPET thing to say"


def plain_score(text, model):
    """The score by its definition: words, features, sentences, one after another."""
    clean = 1.0
    for part in re.split("[.!?\n]", (text or "").lower()):
        words = re.findall(r"(?:[^\W\d_]|[^\x00-\x7f])+", part)
        if not words:
            continue
        total = model.bias
        for w in (w.encode() for w in words):
            for f in [b"=" + w] + [w[:k] for k in range(4, 11) if len(w) >= k]:
                total += model.weights.get(zlib.crc32(f) % toxicity.FEATURES, 0.0)
        clean *= 1 - 1 / (1 + np.exp(-np.clip(total, -30, 30)))
    return 1 - clean


def test_toxicity_scores_match_their_definition():
    texts, toxic = toxic_table(120)
    model = toxicity.learn(texts, toxic, np.ones(120))
    weights = toxicity.WordWeights(model)
    for text in [*texts, "", None, "Été!! 12 snarfle_grolt.\n\nBLIMPET?", "..."]:
        assert abs(toxicity.noisy_or(toxicity.sentence_chances(text, weights)[0]) - plain_score(text, model)) < 1e-9


def test_noisy_or_gradient_is_the_likelihoods():
    """Slopes against differences of the loss, over several chunks and documents without words."""
    texts, toxic = toxic_table(40)
    texts[3] = texts[17] = None
    parts = list(toxicity.chunks(texts, at_once=400))
    assert len(parts) > 3
    y, share = toxic.astype(float), np.full(40, 1 / 40)
    rng = np.random.default_rng(4)
    used = np.unique(np.concatenate([c.feature for c in parts]))
    w = np.zeros(toxicity.FEATURES)
    w[used] = rng.normal(0, 0.3, len(used))
    g, gb, loss = toxicity.slopes(parts, y, share, w, -1.0)
    model = toxicity.SentenceModel(-1.0, dict(zip(used.tolist(), w[used].tolist(), strict=True)))
    chance = np.clip([plain_score(t, model) for t in texts], 1e-9, 1)
    assert abs(loss + np.mean(np.where(y == 1, np.log(chance), np.log1p(-np.minimum(chance, 1 - 1e-15))))) < 1e-6
    for k in used[:: max(1, len(used) // 25)]:
        up, down = w.copy(), w.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        assert abs((toxicity.slopes(parts, y, share, up, -1.0)[2] - toxicity.slopes(parts, y, share, down, -1.0)[2]) / 2e-5 - g[k]) < 1e-6
    assert abs((toxicity.slopes(parts, y, share, w, -1.0 + 1e-5)[2] - toxicity.slopes(parts, y, share, w, -1.0 - 1e-5)[2]) / 2e-5 - gb) < 1e-6


def test_fit_of_distinct_words_is_bounded_by_its_bytes():
    import tracemalloc

    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdefghijklmnop"), (60, 9)).view("U1").reshape(60, 9).astype(object).sum(axis=1)) for _ in range(4000)]
    tracemalloc.start()
    toxicity.learn(texts, np.arange(4000) % 2, np.ones(4000), epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200_000_000, peak  # 240,000 distinct words


def test_training_sample_is_bounded_by_rows_and_characters(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "repeat('word ', 20) as text").union(spark.sql("select 1000L, repeat('long ', 10000)"))
    labels = spark.range(1001).selectExpr("id as doc_id", "int(id % 2) as toxic")
    rows = lambda *most: toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", *most).collect()
    assert len(rows(1000, 1_000_000)) == 401
    assert 20 < len(rows(40, 1_000_000)) < 160 and 20 < len(rows(1000, 4_000)) < 160
    assert max(len(r.text) for r in rows(1000, 100_000)) == 100


def test_toxicity_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (6, 1), (6, 1), (None, 1), (7, None), (5, 3)], "doc_id long, toxic int")
    model = toxicity.train(edge_docs, labels)
    scored = rows_of(toxicity.toxicity(edge_docs, model, keep=["doc_id"]))
    assert len(scored) == edge_docs.count()
    assert all(0 <= r[1] <= 1 and r[2] == int(r[1] >= 0.5) for r in scored)
    assert {r[1] for r in scored if r[0] in (3, 4, 5)} == {0.0}
    kept = toxicity.drop_toxic(edge_docs, model)
    assert kept.columns == edge_docs.columns and 1 in [r.doc_id for r in kept.collect()]
    empty = toxicity.train(no_docs, labels)
    assert toxicity.toxicity(no_docs, empty).count() == 0 and toxicity.train(edge_docs, labels.where("false")).bias < 0


def test_toxicity_held_out_accuracy(spark):
    from larder.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op6_toxicity"](spark, folder).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(got[k].predicted, t) for k, t in labels.items() if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in got)
    assert sum(p == t for p, t in held) / len(held) > 0.85


# ---------------------------------------------------------------- HTML

ARTICLE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Site</a></header><nav><ul><li><a>Menu</a></ul></nav>
<div id=main><div class="post-content"><h2>Head &amp; line</h2><p>First para, with commas, and   text that is
long enough to count.<p>Short.<ul><li>one <b>bo</b>ld<li>two</ul><div class="ad">Buy now</div><blockquote>Quote&nbsp;&lt;x&gt;</blockquote>
<form>f<input></form><script>var t="</p>";</script></div><div class="comments"><p>A reader's comment that is quite long, with commas, and more words.</div></div>
<aside>Side</aside><footer>Foot &copy;</footer><p style="display:none">hidden</body></html>"""


def test_html_article():
    assert main_blocks(ARTICLE) == ["Head & line", "First para, with commas, and text that is long enough to count.", "Short.", "one bold", "two", "Quote <x>"]
    assert main_blocks(None) == main_blocks("") == main_blocks("<p> </p>") == []
    assert main_blocks("<article><h1>Title</h1><p><b>a<br>b<p>c") == ["Title", "a b", "c"]
    assert main_blocks("no tags at all") == ["no tags at all"]


PARAGRAPH = "Long enough paragraph, with commas, and more text than twenty five characters."


def test_html_boilerplate_by_name():
    parts = ['<div class="main-menu"><a>m</a> words, many, many commas, in here</div><div class="page-header">Head, with commas, in it</div>']
    parts.append(f'<div class="content-wrapper has-sidebar"><div class="article-body"><h1>T</h1><p>{PARAGRAPH}</p><div class="related-posts"><p>{PARAGRAPH}</p></div><p>End.</p></div>')
    parts += [f'<div class="{name}"><p>{PARAGRAPH}</p></div>' for name in ("rightSidebar", "cookieNotice", "ad-slot ads", "newsletter_box", "post-comments")]
    parts.append(f'<section class="comment-list"><article class="comment"><p>{PARAGRAPH}</p></article></section></div><div class="site-footer">f</div>')
    assert main_blocks(f"<html><body>{''.join(parts)}</body></html>") == ["T", PARAGRAPH, "End."]


def test_html_article_keeps_its_own_header_and_sections():
    page = f"<body><header>site</header><table><tr><td><ul><li>nav</ul></td><td><p>{PARAGRAPH}</td></tr></table><article><header><h1>Own</h1></header><section><p>{PARAGRAPH}</section><section><h2>Part</h2><pre>code  x</pre></section></article></body>"
    assert main_blocks(page) == ["Own", PARAGRAPH, "Part", "code x"]


def test_html_broken_and_huge_pages():
    assert main_blocks("<div>" * 50_000 + "deep" + "</div>" * 50_000) == ["deep"]
    assert main_blocks('<p>text<a href="' * 3) != []
    assert main_blocks("<<<>>> & &amp; &bogus; <b") == ["<<<>>> & & &bogus;"]
    assert len(main_blocks("<article>" + "<p>word, word" * 20_000)) == 20_000


def test_html_elements_without_an_end_do_not_swallow_the_page():
    for tag in ("svg", "select", "iframe", "object", "video", "noscript", "math", "template"):
        page = f"<article><p>{PARAGRAPH}</p><{tag} a='1'>inner<p>{PARAGRAPH} Second.</p><p>Third</p></article>"
        assert main_blocks(page) == [PARAGRAPH, f"{PARAGRAPH} Second.", "Third"], tag
        nested = f"<article><p>{PARAGRAPH}</p><{tag}>a<{tag}>b</{tag}>c</{tag}><p>After</p></article>"
        assert main_blocks(nested) == [PARAGRAPH, "After"], tag
    assert main_blocks(f"<article><p>{PARAGRAPH}</p><script>x<p>{PARAGRAPH}") == [PARAGRAPH]
    assert main_blocks(f"<article><p>{PARAGRAPH}</p><svg/><p>b</p><svgx>c</svgx><svg>d</svg></article>") == [PARAGRAPH, "b", "c"]
    assert main_blocks("<svg>" * 20_000 + "<p>text") == ["text"]


def plain_main_blocks(page):
    """The choice by its definition: sums over all blocks for each node, ancestors looked up one by one."""
    from larder.llm import html_text as H

    nodes, blocks = H.blocks_of(page or "")
    up = lambda n: [] if n is None else [n, *up(n.parent)]
    kept = [b for b in blocks if not any(n.unlikely for n in up(b[0]))]
    if not kept:
        return []
    below = lambda n: [b for b in kept if n in up(b[0])]
    chars = lambda n: sum(len(t) for _, t, _ in below(n))
    links = lambda n: sum(x for _, _, x in below(n))

    def points(n):
        total = 0.0
        for node, text, _ in kept:
            containers = [m for m in up(node) if m.tag in H.CONTAINERS][:5]
            if len(text) >= 25 and n in containers:
                total += (1 + min(sum(text.count(c) for c in ",、，"), 10) + min(len(text) / 100, 3)) * (1, 1 / 2, 1 / 6, 1 / 9, 1 / 12)[containers.index(n)]
        return total

    def worth(n):
        base = points(n) * (1.25 if n.likely else 1) + (25 if n.tag in ("article", "main") and chars(n) else 5 if n.likely and points(n) else 0)
        return base * (1 - links(n) / max(chars(n), 1))

    held = [n for n in nodes if n.tag in H.CONTAINERS and chars(n) and not any(m.unlikely for m in up(n))]
    worths = {n.order: worth(n) for n in held}
    best = max(held, key=lambda n: (round(worths[n.order], 9), -n.order))
    beside = [n for n in held if n.parent is best.parent and n is not best and worths[n.order] >= max(10.0, 0.2 * worths[best.order]) and links(n) <= 0.25 * chars(n)]
    lone = lambda n, t, x: n.parent is best.parent and n.tag == "p" and len(t) >= 80 and x <= 0.25 * len(t)
    return [t for n, t, x in kept if any(m in [best, *beside] for m in up(n)) or lone(n, t, x)]


def random_page(rng):
    out = []
    for _ in range(int(rng.integers(3, 40))):
        kind = rng.integers(0, 9)
        name = rng.choice(["div", "section", "article", "td", "ul", "main", "aside", "p", "li", "h2", "header", "blockquote"])
        if kind < 4:
            out.append(f'<{name} class="{rng.choice(["", "content", "sidebar", "post-body", "ad", "x"])}">')
        elif kind < 6:
            out.append(f"</{name}>")
        else:
            words = " ".join(rng.choice(["word", "longer, text", "and", "a<a href=x>link here</a>"], int(rng.integers(1, 40))))
            out.append(f"<p>{words}" if kind < 8 else words)
    return "".join(out)


def test_html_choice_matches_its_definition(spark):
    rng = np.random.default_rng(8)
    pages = [random_page(rng) for _ in range(150)] + [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()] + [ARTICLE, None, ""]
    kept = 0
    for page in pages:
        got = main_blocks(page)
        assert got == plain_main_blocks(page), page
        kept += bool(got)
    assert kept > 100


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, "u", ARTICLE, 5), (1, "u", ARTICLE, 5), (2, None, None, None), (None, "v", "<p>été", 1)], "page_id long, url string, html string, text long")
    got = rows_of(extract_text(pages))
    assert len(got) == 4 and (2, None, "", 0) in got and (None, "v", "été", 3) in got
    assert got.count(next(r for r in got if r[0] == 1)) == 2
    assert rows_of(extract_text(pages.where("false"))) == []


def test_long_text_is_read_whole():
    assert licenses.words_of(LONG)[1] == 48_000
