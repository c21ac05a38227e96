"""Dictionary matching, spans and extractors on literal texts."""

import json
import re

import pytest

from larder.operators import extractors as E
from larder.operators import text_match as M


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def terms(spark, *patterns):
    return spark.createDataFrame([(f"k:{p}", p, p) for p in patterns], "key string, name string, pattern string")


CASES = [
    ("I love Big Apple and bay area.", ["big apple", "bay area"], [(7, 16, "big apple"), (21, 29, "bay area")]),
    ("new york new york city", ["new york", "new york city"], [(0, 8, "new york"), (9, 22, "new york city")]),
    ("newyork new", ["new"], [(8, 11, "new")]),
    ("crème brûlée", ["br"], [(6, 8, "br")]),
    ("a b c", ["a b d", "b c"], [(2, 5, "b c")]),
    ("été être", ["être"], [(4, 8, "être")]),
    ("İ bio", ["bio"], [(2, 5, "bio")]),
    ("MIDİ", ["midi"], [(0, 4, "midi")]),
    ("c++ code", ["c++"], [(0, 3, "c++")]),
]


@pytest.mark.parametrize("limit", [2000, 0])
@pytest.mark.parametrize("text,patterns,expected", CASES)
def test_dictionary(spark, text, patterns, expected, limit):
    rows = M.dict_match(frame(spark, text), terms(spark, *patterns), joined=limit == 0).collect()
    assert sorted((r["start"], r["end"], r["pattern"]) for r in rows) == expected


def test_fuzzy(spark):
    rows = M.dict_match_fuzzy(frame(spark, "I love big aple and baay area"), terms(spark, "big apple", "bay area"), 1).collect()
    assert sorted((r["pattern"], r["cost"]) for r in rows) == [("bay area", 1), ("big apple", 1)]


def test_offsets_of_many_matches(spark):
    text = "ab é12 " * 300
    rows = M.regex_extract(frame(spark, text), [("n", "full", "[0-9]+", [])]).collect()
    assert len(rows) == 300 and all(text[r["start"]:r["end"]] == "12" == r["raw"] for r in rows)


@pytest.mark.parametrize(
    "text,expected",
    [
        ("poids net à l'emballage 500g", [("500 g", True, "with_mention")]), ("230g net", [("230 g", True, "with_ending_mention")]), ("2 x 150 g", [("2 x 150 g", True, "multi_packaging")]),
        ("150 ge", [("150 g", False, "no_mention")]), ("poids net: 1255 g", [("1255 g", False, "with_mention")]), ("poids net 05 g", []), ("25 x 100 g", []), ("poids net 525. g", [("525 g", True, "with_mention")]),
    ],
)
def test_weight(spark, text, expected):
    rows = E.extract_product_weight(frame(spark, text)).collect()
    assert [(r["value"], r["automatic_processing"], json.loads(r["data"])["matcher_type"]) for r in rows] == expected


def test_dates(spark):
    rows = E.extract_expiration_date(frame(spark, "15/10/2018 31.02.19 01-01-2030 02-03-21")).collect()
    assert sorted(r["value"] for r in rows) == ["2018-10-15", "2021-03-02"]


def test_packager_codes(spark):
    rows = E.extract_packager_code(frame(spark, "EMB 60282A\nde BY-718 EG fr 40.261.001 ce FSC.C123456 RSPO-1234567 FR-123-456")).collect()
    assert sorted(r["value"] for r in rows) == sorted(["EMB 60282A", "DE BY-718 EC", "FR 40.261.001 EC", "FSC-C123456", "RSPO-1234567", "FR-123-456"])


def test_organic_codes(spark):
    rows = E.extract_label(frame(spark, "FR-BIO-01 DE-ÖKO-07 DE-ÖKO-007 ES-ECO-001-AN")).collect()
    assert sorted(r["value_tag"] for r in rows) == ["en:de-öko-007", "en:es-eco-001-an", "en:fr-bio-01"]


def test_literals_cover_their_patterns(spark):
    """The substring test never hides a match, dotted and long letters included."""
    rows = E.extract_label(frame(spark, "AGRİCULTURE BİO.", "ſans", "HOMOLOGATION LA 01/02", "certifié ab.")).collect()
    assert {r["value_tag"] for r in rows} >= {"fr:label-rouge", "fr:ab-agriculture-biologique"}


def test_packaging(spark):
    got = E.extract_packaging(frame(spark, "Bouteille en plastique PET à recycler, plaque"), {"bouteille": "en:bottle", "plaque": "en:backing"}, {"plastique": "en:plastic", "pet": "en:pet"}, {"recycler": "en:recycle"}).collect()
    assert [r["value"] for r in got] == ["{'shape': 'en:bottle', 'material': 'en:pet', 'recycling': 'en:recycle'}"]


def test_location(spark):
    cities = spark.createDataFrame([("orleans", "45000"), ("paris", "75001")], "name string, postal_code string")
    rows = E.extract_location(frame(spark, "45000 Orléans, paris 75 001"), cities).collect()
    assert [json.loads(r["data"])["city_name"] for r in rows] == ["orleans"]


def test_span_extension(spark):
    text = "eau, sel. *issu de l'agriculture biologique. Autre"
    df = spark.createDataFrame([(text, 8)], "text string, end int")
    end = E.extend_span_mentions(df).first()["end"]
    assert text[:end] == "eau, sel. *issu de l'agriculture biologique"


def plain_matches(text, patterns):
    """Leftmost, longest, not overlapping, by trying every pattern everywhere."""
    word = lambda c: c.isascii() and (c.isalnum() or c == "_")
    low, out, at = text.lower(), [], 0
    while at < len(low):
        fits = [p for p in patterns if low.startswith(p, at) and not (at and word(low[at - 1])) and not (at + len(p) < len(low) and word(low[at + len(p)]))]
        if fits:
            best = max(fits, key=len)
            out.append((at, at + len(best), best))
            at += len(best)
        else:
            at += 1
    return out


TERMS = ["new york", "york", "new", "new york pizza", "été", "épinard", "-free", "sugar-free", "a", "bio", "l'eau", "x.y", "12", "%", "%%", "été bio", "kiwi", "ni"]
TEXTS = [
    "New York pizza york", "NEW YORK  pizza", "newyork new_york new-york", "Été bio, épinards épinard l'eau L'EAU", "sugar-free -free x-free --free", "x.y xy x.yz 12 123 %12%% %%%",
    "", "a" * 50, "Kiwİ ni niİ", "anew new", "new\nyork new york", "é", "a b a_ a", "bio" + "́ bio",
]


def terms_table(spark, patterns):
    return spark.createDataFrame([(f"k{p}", p, p.upper()) for p in patterns], "key string, name string, pattern string")


@pytest.mark.parametrize("form", [{}, {"joined": True}, {"most_chars": 0}])
def test_dictionary_matches_equal_trying_everything(spark, form):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.end, r.pattern) for r in M.dict_match(df, terms_table(spark, TERMS), **form).collect())
    want = sorted((k, s, e, p) for k, t in enumerate(TEXTS) if "İ" not in t for s, e, p in plain_matches(t, TERMS))
    assert [g for g in got if "İ" not in TEXTS[g[0]]] == want
    dotted = [(g[1], g[3]) for g in got if "İ" in TEXTS[g[0]]]
    assert dotted == [(0, "kiwi"), (5, "ni")]
    assert all(r.matched.lower().replace("i̇", "i") == r.pattern for r in M.dict_match(df, terms_table(spark, TERMS), **form).collect())


def test_a_hundred_thousand_terms_match_in_every_form(spark):
    patterns = [f"w{k} x{k % 7}" for k in range(100_000)] + ["w5", "w77 x0 tail"]
    texts = [" ".join(f"w{(k * j) % 100_003} x{(k + j) % 7}" for j in range(40)) + " w77 x0 tail" for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = spark.createDataFrame([(p, p, p) for p in patterns], "key string, name string, pattern string")
    rows = lambda **form: sorted((r.doc_id, r.start, r.pattern) for r in M.dict_match(df, terms, **form).collect())
    whole = rows()
    assert len(whole) > 300 and whole == rows(joined=True) == rows(most_chars=1000)
    known = set(patterns)
    for k in (0, 7, 31):  # every start, longest first
        words, want = texts[k].split(" "), []
        at, i = 0, 0
        while i < len(words):
            n = next((n for n in (3, 2, 1) if " ".join(words[i : i + n]) in known), 0)
            if n:
                want.append((k, at, " ".join(words[i : i + n])))
            at += sum(len(w) + 1 for w in words[i : i + max(n, 1)])
            i += max(n, 1)
        assert [w for w in whole if w[0] == k] == want


def test_several_dictionaries_keep_their_own_matches(spark):
    df = spark.createDataFrame([(1, "new york pizza"), (2, None), (3, "")], "doc_id long, text string")
    found = M.match_dictionaries(df, {"a": terms_table(spark, ["new york", "pizza"]), "b": terms_table(spark, ["york pizza", "new"]), "none": terms_table(spark, ["x"]).where("false")})
    assert {n: sorted((r.start, r.pattern) for r in rows.collect()) for n, rows in found.items()} == {"a": [(0, "new york"), (9, "pizza")], "b": [(0, "new"), (4, "york pizza")], "none": []}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(row[j] + 1, last[j + 1] + 1, last[j] + (x != y)))
    return row[-1]


def plain_fuzzy(text, patterns, budget):
    """Walks every pattern from every word, spending the budget word by word."""
    low = text.lower()
    words = [m.span() for m in re.finditer("[a-z0-9_]+", low)]
    hits = []
    for i, (start, _) in enumerate(words):
        for p in patterns:
            parts = re.findall("[a-z0-9_]+|[^a-z0-9_]+", p)
            wanted, seps = parts[::2], parts[1::2]
            spans = words[i : i + len(wanted)]
            if len(spans) < len(wanted) or any(low[a[1] : b[0]] != sep for a, b, sep in zip(spans, spans[1:], seps, strict=False)):
                continue
            costs = [edits(low[a:b], w) for (a, b), w in zip(spans, wanted, strict=True)]
            if sum(costs) <= budget:
                hits.append((start, -spans[-1][1], sum(costs), p))
    out, free = [], 0
    for start, end, cost, p in sorted(hits):
        if start >= free:
            out.append((start, -end, p, cost))
            free = -end
    return out


def test_fuzzy_matches_of_known_sentences(spark):
    df = spark.createDataFrame([(1, "I love Big Aple and Baay Area."), (2, "I love Big Apple and Bay Area."), (3, "maria mari marie"), (4, "new york pizza york"), (5, "big  apple big-apple bigg aple")], "doc_id long, text string")
    terms = terms_table(spark, ["big apple", "bay area", "marie", "new york", "york"])
    got = sorted((r.doc_id, r.start, r.end, r.pattern, r.cost) for r in M.dict_match_fuzzy(df, terms, 1).collect())
    assert got == [(1, 7, 15, "big apple", 1), (1, 20, 29, "bay area", 1), (2, 7, 16, "big apple", 0), (2, 21, 29, "bay area", 0), (3, 0, 5, "marie", 1), (3, 6, 10, "marie", 1), (3, 11, 16, "marie", 0), (4, 0, 8, "new york", 0), (4, 15, 19, "york", 0)]


@pytest.mark.parametrize("budget", [0, 1, 2])
def test_fuzzy_matches_equal_a_plain_walk(spark, budget):
    import random

    rng = random.Random(budget)
    stem = ["lemon", "lemons", "demon", "sugar", "cane", "cane sugar", "raw cane sugar", "salt", "sea-salt", "lemon salt", "melon", "e330"]
    spoil = lambda w: "".join(c if rng.random() > 0.08 else rng.choice(["", "x", c + c]) for c in w)
    texts = [rng.choice([" ", ", ", "-"]).join(spoil(rng.choice(stem)) for _ in range(25)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.end, r.pattern, r.cost) for r in M.dict_match_fuzzy(df, terms_table(spark, stem), budget).collect())
    assert got == sorted((k, *m) for k, t in enumerate(texts) for m in plain_fuzzy(t, stem, budget))


def test_fuzzy_terms_keep_their_outer_separators(spark):
    df = spark.createDataFrame([(1, "épinard xépinard épinrd pinard"), (2, "100% jus 100%jus 100 %"), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.end, r.pattern) for r in M.dict_match_fuzzy(df, terms_table(spark, ["épinard", "100%", "%"]), 1).collect())
    assert got == [(1, 0, 7, "épinard"), (1, 17, 23, "épinard"), (2, 0, 4, "100%")]


def test_all_default_types_come_from_one_reading(spark, tmp_path):
    from larder import fixed

    texts = [
        "Poids net 200 g\nEMB 56251A\ningrédients biologiques. Carrefour Market", "bouteille en plastique a recycler\nfumer tue\n12/05/2021", "Énergie: 120 kJ, protéines 3,5 g\ncoca cola", None, "",
    ]
    rows = [(f"i{k}", t, {"adult": "VERY_LIKELY" if k == 3 else "LIKELY", "violence": "UNKNOWN"}) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "source_image string, text string, safe_search struct<adult:string,violence:string>").coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    words = spark.createDataFrame([("i0", 0, "up", "fr"), ("i0", 1, "up", None), ("i9", 0, "left", "en")], "source_image string, word_idx int, orientation string, lang string")
    arguments = {
        "brand": {"curated": terms(spark, "coca cola"), "from_taxonomy": None}, "category": {"nodes": spark.createDataFrame([("fr:x",)], "id string")},
        "store": {"stores": [("Carrefour Market", None), ("Carrefour", None)]}, "packaging": {"shapes": {"bouteille": "en:bottle"}, "materials": {"plastique": "en:plastic"}, "recyclings": {"recycler": "en:recycle"}},
        "image_flag": {"words": terms(spark, "fumer tue")}, "image_lang": {"words": words}, "image_orientation": {"words": words}, "label": {"dictionary": terms(spark, "ingrédients", "en:x")},
    }
    got = E.extract_all(df, **arguments)
    columns = ["source_image", *E.PREDICTION_COLUMNS]
    whole = sorted(map(str, got.select(columns).collect()))
    alone = []
    for t in fixed.OCR_DEFAULT_TYPES:
        one = E.extract_all(df, [t], **{k: v for k, v in arguments.items() if k == t}) if t.startswith("image_") else E.extract_type(df, E.TEXT_TYPES[t](**arguments.get(t, {})), ["source_image"], "text")
        alone += map(str, one.select(columns).collect())
    assert whole == sorted(alone) and len(whole) > 15
    assert {r.type for r in got.collect()} == set(fixed.OCR_DEFAULT_TYPES) - {"category"}
    huge = E.scanned(df, {"label": E.label_type(terms(spark, "ingrédients"))}, ["source_image"], "text", most_chars=1)  # dictionaries over the bound
    assert [r.value_tag for r in huge[0].where("predictor = 'flashtext'").collect()] == ["k:ingrédients"]
    with pytest.raises(KeyError):
        E.extract_all(df, ["no such type"])


@pytest.mark.parametrize("most_first_words,hot", [(0, 2), (2, 1), (5, 1_000_000)])
def test_large_dictionaries_match_after_the_words_of_the_texts_are_counted(spark, most_first_words, hot):
    texts = ["w1 x0 w1 x0, W2 a", "w1 x0", "%5 w3", "", None, "kiwİ w9"]
    patterns = ["w1 x0", "w1", "w2 a", "%5", "kiwi", "absent", "absent two", "other"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lambda hits: sorted((r.doc_id, r.start, r.end, r.pattern, r.matched) for r in hits.collect())
    got = rows(M.dict_match_join(df, terms(spark, *patterns), most_first_words=most_first_words, hot=hot))
    assert got == rows(M.dict_match(df, terms(spark, *patterns))) and len(got) == 6


GATED_TEXTS = [
    "Poids net 200 g EMB 56251A", "POIDS NET\r\n200 g", "ingrédients\nbiologiques, INGRÉDIENTS BIO.", "БЕЗ КОНСЕРВАНТОВ и без ароматизаторов", "eiweiß: 3,5 g EIWEIẞ 2 g", "énergie 120 KJ",
    "ſel 2 g, ſucreſ", "PROTEİNAS 3g proteınas", "le sel 1 G", "2 x 100 g, 100 g net", "12/05/2021 12.05.21", "FR-BIO-01 DE ÖKO-001, DE-ÖKO-001", "super\r\nu, Super U", "appellation camembert contrôlée",
    "bleu appellation d'origine protégée", "roquefort AOP", "﷐sel 1 g﷑ sel 2 g", "sans  conservateur", "homologation n° la 12/34 LA ١٢/34", "fără conservanţi", "œuf boîte en  plastique a recycler", None, "", "x",
]


def test_patterns_that_a_text_may_hold_are_found_first(spark, monkeypatch):
    from larder.operators import extractors as E

    kinds = [
        E.packager_code_type(), E.label_type(), E.product_weight_type(), E.expiration_date_type(), E.nutrient_type(), E.nutrient_mention_type(), E.store_type([("U", "super u"), ("Carrefour Market", None)]),
        E.category_type(spark.createDataFrame([("fr:x",)], "id string")), E.packaging_type({"boite": "en:box"}, {"plastique": "en:plastic"}, {"recycler": "en:recycle"}),
    ]
    patterns = [p for kind in kinds for p in kind.patterns]
    df = spark.createDataFrame(list(enumerate(GATED_TEXTS)), "doc_id long, text string")
    found = M.scan_texts(df, patterns, {})
    assert "ArrowEvalPython" in found._jdf.queryExecution().optimizedPlan().toString()
    assert [p[0] for p in patterns if M.relaxed(p[2]) is None] == []  # packaging, in folded texts, is not told by its own
    got = sorted(map(str, found.collect()))
    monkeypatch.setattr(M, "MOST_UNTOLD", 1000)
    assert got == sorted(map(str, M.scan_texts(df, patterns, {}).collect())) and len(got) > 40


def test_relaxed_patterns():
    assert M.relaxed("(?iu)(?<![a-z])ab [cd]+(?!x)") == r"ab(?:\r\n|[ \r\n])[cd]+"
    assert [M.relaxed(p) for p in (r"(a)\1", "(?=a)(?:b(?=(c)))", r"\Qa\E", "a++", "(?x)a b", "a?", r"\p{L}")] == [None] * 7


def test_marks_in_a_text_are_no_matches(spark):
    texts = ["a1 ﷐b2﷑ c3", "a1 b2  c3", "none", "﷐"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = M.regex_extract(df, [("word", "full", "([a-z])([0-9])|(zz)", [1, 2, 3])]).orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.raw, r.g, r.start, r.end) for r in rows] == [(k, w, [w[0], w[1], ""], texts[k].index(w), texts[k].index(w) + 2) for k in (0, 1) for w in ("a1", "b2", "c3")]
