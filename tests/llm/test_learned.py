"""Operators that SQL cannot state: brute force, small pages and held-out accuracy."""

import math
import random

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from creditpath.llm import html_extraction, simhash
from creditpath.llm.components import components
from creditpath.llm.html_extraction import Shape, aligned, extracted, main_text
from creditpath.llm.language_id import Segmenter, languages, words_of
from creditpath.llm.quality_classifier import quality_scores
from creditpath.llm.simhash import fingerprint, fingerprint_groups, near_duplicate_classes

FOLDER = f"{DATA}/sf0.01"


def classes_of(numbers, max_bits=4):
    numbers = sorted(numbers)
    root = {n: n for n in numbers}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(numbers):
        for b in numbers[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= max_bits:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {n: top(n) for n in numbers}


def test_fingerprint_groups_against_brute_force(spark):
    rng = random.Random(3)
    numbers = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            n = centre
            for bit in rng.sample(range(64), rng.randrange(7)):
                n ^= 1 << bit
            numbers.add(n - (1 << 64) if n >> 63 else n)
    found = dict(fingerprint_groups(spark.createDataFrame([(n,) for n in numbers], "fp long")).collect())
    assert {n: found.get(n, n) for n in numbers} == classes_of(numbers)


def test_a_large_group_is_not_paired_with_itself(spark):
    base = 0x123456789ABCDEF
    large = [base ^ (1 << a) ^ (1 << b) for a in range(46, 62) for b in range(46, a)]
    strays = [base ^ (1 << 3) ^ (1 << 50), base ^ (7 << 30) ^ (1 << 58)]
    rows = [(n, 1) for n in large]
    assert simhash._candidates(spark.createDataFrame(rows, "fp long, root long")).count() == 0
    rows += [(n, 10 + i) for i, n in enumerate(strays)]
    pairs = simhash._candidates(spark.createDataFrame(rows, "fp long, root long"))
    found = [(r["u"], r["v"]) for r in pairs.collect()]
    # At most each stray with each member, under each of the signatures; one of a pair is a stray.
    assert 0 < len(found) <= 2 * 47 * len(rows) and all(u in strays or v in strays for u, v in found)
    near = {tuple(sorted(p)) for p in found if (p[0] ^ p[1]).bit_count() <= 4}
    assert near == {tuple(sorted((s, n))) for i, s in enumerate(strays) for n in large + strays[:i] if (s ^ n).bit_count() <= 4}


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)]
    found = dict(components(spark.createDataFrame(links, "u long, v long")).collect())
    assert found == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def test_near_duplicates_edges(spark):
    rows = [(5, None), (3, ""), (9, "One two three"), (9, "one two THREE"), (None, "one two three"), (1, "other words")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in near_duplicate_classes(docs).collect())
    assert got == [(0, 9), (1, 1), (3, 3), (5, 3), (9, 9), (9, 9)]
    assert near_duplicate_classes(docs.limit(0)).count() == 0
    assert fingerprint(None) == 0 and fingerprint("a " * 200_000) == fingerprint("a a a a")


def test_main_text():
    page = (
        "<!DOCTYPE html><html><body><nav><li>Menu</nav><div class='cookie-notice'>Cookies</div><article><h1>T &amp; &eacute;</h1>"
        "<p>One <b>bold</b>\n text<br>more<p>Two<ul><li>a<li>b</ul><div class=ad>Buy</div><section id='comments'><p>no</p></section>"
        "<form>f</form><script>var x='</p>'</script></article><footer>(c)</footer></body>"
    )
    assert main_text(page) == "T & é\n\nOne bold text more\n\nTwo\n\na\n\nb"
    assert main_text(None) == "" and main_text("<div>") == "" and main_text("<i>" * 5000 + "deep") == "deep"


def test_wrapper_finds_what_varies(spark):
    rows = [
        (i, f"http://h.example/{i}", f"<div><div>Site name</div><div><p>Text {i}</p><p>More {i * 7}</p></div><div>All rights</div></div>")
        for i in range(8)
    ]
    rows += [(8, None, None), (None, "http://h.example/1", ""), (0, rows[0][1], rows[0][2]), (9, "http://one.example", "<p>a</p><p>a</p>")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n_chars int")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in extracted(pages).collect()]
    assert len(got) == 12 and got.count((0, "Text 0\n\nMore 0", 14)) == 2
    assert (3, "Text 3\n\nMore 21", 15) in got and (8, "", 0) in got and (9, "a\n\na", 4) in got
    assert extracted(pages.limit(0)).count() == 0


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_scores(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.93
    odd = spark.createDataFrame([(None, "a"), (1, None), (1, None), (2, "x" * 50_000)], "doc_id long, text string")
    odd = odd.withColumn("score", F.lit("clash"))
    assert quality_scores(odd, labels.limit(0)).where("score = 0.5 AND predicted = 1").count() == 4
    assert quality_scores(docs.limit(0), labels).count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = languages(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.97
    odd = spark.createDataFrame([(None, "a", None), (1, None, "en"), (1, "12 -", "en"), (2, "b" * 9_000, "en")], "doc_id long, text string, lang string")
    got = {(r["doc_id"], r["lang_pred"]) for r in languages(odd).collect()}
    assert {(1, "und")} <= got and all(p in ("und", "en") for _, p in got)
    assert languages(odd.limit(0)).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER).cache()
        sizes.append(out.count())
        if name == "near_dedup":
            texts = [r["text"] for r in out.collect()]
            assert len(set(texts)) == len(texts)
        if name == "mixed":
            assert out.where("rate < 0").count() == 0
        else:
            assert out.columns == corpus_pipeline.COLUMNS
        docs = out
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[1] > sizes[2] > sizes[3] and sizes[3] == sizes[5]


def texts_of(spark, pages):
    """The extracted text by page_id of pages (url, html)."""
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in extracted(rows).collect()}


def test_template_reaches_into_articles(spark):
    pages = [
        (f"http://a.example/{i}", f"<main><h1>Title {i}</h1><article><p>Text {i}</p><p>Share this with all your friends</p></article></main>")
        for i in range(8)
    ]
    copied = "<article><h1>One title</h1><p>One text</p><p>Another text</p>"
    pages += [(f"http://b.example/{i}", f"{copied}<p>Seen {i}</p></article><div>Site name</div>") for i in range(4)]
    found = texts_of(spark, pages)
    assert all(found[i] == f"Title {i}\n\nText {i}" for i in range(8))
    assert all(found[8 + i] == f"One title\n\nOne text\n\nAnother text\n\nSeen {i}" for i in range(4))
    assert main_text("<main><h1>Title</h1><article>Text</article></main><div>Other</div>") == "Title\n\nText"


def test_template_counts_all_pages_of_all_layouts(spark):
    body = "".join(f"<p>Word {{0}}-{i}</p>" for i in range(450))
    pages = [(f"http://a.example/{i}", f"<div>Old menu</div><div>{body.format(i)}</div><div>All rights</div>") for i in range(30)]
    pages += [(f"http://a.example/n{i}", f"<section><div>New menu</div><p>Text {i}</p><p>New end</p></section>") for i in range(10)]
    pages += [(f"http://b.example/{i}", f"<div>Site</div><p>Text {i}</p>") for i in range(2)]
    found = texts_of(spark, pages)
    assert all(found[i] == "\n\n".join(f"Word {i}-{k}" for k in range(450)) for i in range(30))
    assert all(found[30 + i] == f"Text {i}" for i in range(10)) and found[40] == "Text 0" and found[41] == "Text 1"


def test_constant_text_inside_of_an_article_stays(spark):
    recipe = (
        "<div>Cooking site</div><article><h1>Dish {0}</h1><p>Story {0}</p><h2>Ingredients</h2><ul><li>salt<li>item {0}</ul>"
        "<h2>Method</h2><p>Cook {0}</p><p>Tell your friends</p></article><div>All rights</div>"
    )
    byline = "<article><h1>News {0}</h1><p>By {1}</p><p>Story {0}</p></article><div>Contact</div>"
    pages = [(f"http://a.example/{i}", recipe.format(i)) for i in range(10)]
    pages += [(f"http://b.example/{i}", byline.format(i, "Ann" if i < 4 else f"Guest {i}")) for i in range(10)]
    found = texts_of(spark, pages)
    for i in range(10):
        assert found[i] == f"Dish {i}\n\nStory {i}\n\nIngredients\n\nsalt\n\nitem {i}\n\nMethod\n\nCook {i}"
        assert found[10 + i] == f"News {i}\n\nBy {'Ann' if i < 4 else f'Guest {i}'}\n\nStory {i}"


def test_slots_are_aligned_by_order_and_not_by_position(spark):
    page = "<div><p>Breaking{0}</p></div><section>{1}<p>Text {0}</p><p>Also {0}</p></section><div>Imprint</div><div>{2}</div>"
    pages = [
        (f"http://a.example/{i}", page.format(i, f"<p>Extra {i}</p>" * (i % 3), "Imprint" if i == 1 else f"Seen {i} times"))
        for i in range(9)
    ]
    found = texts_of(spark, pages)
    for i in range(9):
        blocks = [f"Breaking{i}", *[f"Extra {i}"] * (i % 3), f"Text {i}", f"Also {i}"]
        assert found[i].split("\n\n")[: len(blocks)] == blocks


def random_shape(rng, size):
    ups = [-1] + [rng.randrange(at) for at in range(1, size)]
    # Children follow their parents in page order.
    below = {at: [c for c in range(1, size) if ups[c] == at] for at in range(size)}
    order, stack = [], [0]
    while stack:
        order.append(stack.pop())
        stack.extend(reversed(below[order[-1]]))
    place = {at: n for n, at in enumerate(order)}
    labels = [0 if not n else rng.randrange(2) for n in range(size)]
    return Shape([place.get(ups[at], -1) for at in order], labels, [rng.randrange(3) for _ in order])


def plain_score(one, two, i, j):
    """Simple tree matching as it is written down: all prefixes of both child lists."""
    if one.labels[i] != two.labels[j]:
        return 0
    a, b = one.children[i], two.children[j]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for m, x in enumerate(a, 1):
        for n, y in enumerate(b, 1):
            best[m][n] = max(best[m - 1][n], best[m][n - 1], best[m - 1][n - 1] + plain_score(one, two, x, y))
    return 1 + (one.keys[i] == two.keys[j] != 0) + best[-1][-1]


@pytest.mark.parametrize("small", [0, 1_000])
def test_tree_matching_against_brute_force(monkeypatch, small):
    monkeypatch.setattr(html_extraction, "SMALL_PAIRS", small)
    rng = random.Random(5)
    for _ in range(400):
        one, two = random_shape(rng, rng.randint(1, 14)), random_shape(rng, rng.randint(1, 14))
        pairs = aligned(one, two)
        assert pairs[0] == (0, 0) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        partner = dict(pairs)
        assert all(partner[one.ups[i]] == two.ups[j] for i, j in pairs[1:])
        by_page = sorted(pairs)
        siblings = [(x, y) for x, y in zip(by_page, by_page[1:]) if one.ups[x[0]] == one.ups[y[0]]]
        assert all(x[1] < y[1] for x, y in siblings)
        got = sum(1 + (one.keys[i] == two.keys[j] != 0) for i, j in pairs)
        assert got == plain_score(one, two, 0, 0)
    # Long lists of children are split at those that are equal and single.
    monkeypatch.setattr(html_extraction, "LEAF_PAIRS", 100)
    n = 300
    one = Shape([-1] + [0] * n, [7] * (n + 1), [0] + list(range(1, n + 1)))
    two = Shape([-1] + [0] * (n - 5), [7] * (n - 4), [0] + [k for k in range(1, n + 1) if k % 60])
    assert all(one.keys[i] == two.keys[j] for i, j in aligned(one, two)) and len(aligned(one, two)) == n - 4


def score_of(one, two):
    return sum(1 + (one.keys[i] == two.keys[j] != 0) for i, j in aligned(one, two))


@pytest.mark.parametrize("limits", [{"LEVELS": 0}, {"LEVELS": 1, "KNOWN": 2}, {"LEAF_PAIRS": 1, "SMALL_PAIRS": 0}, {"SMALL_PAIRS": 0, "FLAT": 1}])
def test_matching_is_the_same_however_it_is_computed(monkeypatch, limits):
    rng = random.Random(6)
    shapes = [(random_shape(rng, rng.randint(1, 30)), random_shape(rng, rng.randint(1, 30))) for _ in range(200)]
    plain = [aligned(one, two) for one, two in shapes]
    for name, value in limits.items():
        monkeypatch.setattr(html_extraction, name, value)
    assert [sorted(p) for p in plain] == [sorted(aligned(one, two)) for one, two in shapes]


def test_deep_and_long_pages_are_aligned_by_the_same_rule():
    def shape(html):
        return html_extraction.shape_of(html_extraction.outline(html_extraction.parsed(html)))[0]

    # Levels are kept, however deep: a text is aligned at its own level only.
    deep = [shape("<div>" * n + "<p>a</p><p>b</p>" + "</div>" * n) for n in (300, 301)]
    assert max(deep[0].children, key=len) == [301, 302] and deep[0].ups[300] == 299
    assert score_of(deep[0], deep[0]) == 305 and score_of(*deep) == 301
    many = [shape("<div><p>x</p>" * 3000 + str(n)) for n in range(2)]
    assert score_of(*many) == 1 + 3000 * 3
    # 120 rows of two cells each, none equal, the second page without the first row: each row goes with its like.
    rows = [f"<tr><td>{n}</td><td>{{0}}{n}</td></tr>" for n in range(120)]
    one, two = (shape("<table>" + "".join(r.format(p) for r in kept) + "</table>") for p, kept in (("a", rows), ("b", rows[1:])))
    assert score_of(one, two) == 2 + 119 * 4
    # The same for 1,200 leaves without a single equal one at its place.
    one, two = (shape("".join(f"<p>{n % 600}</p>" for n in range(at, 1200))) for at in (0, 1))
    assert score_of(one, two) == 1 + 1199 * 2


def test_marked_wrappers_keep_the_page(spark):
    for page in (
        "<div class='layout with-sidebar'><p>Whole text</p></div><nav>Menu of links</nav>",
        "<div id=content class=no-sidebar><article>Whole text</article></div><div class=sidebar>Much longer text at the side</div>",
        "<article class=has-comments>Whole text<div class=comments>no</div></article>",
        "<form><nav>Menu of many links</nav><div>Whole text</div><footer>(c)</footer></form>",
        "<div class='page-header'><main>Whole text</main></div>",
    ):
        assert main_text(page) == "Whole text", page
    wrapped = "<div class='with-sidebar'><div>Site name and a long notice</div><p>Text {0}</p></div><div class=comments>Reply</div>"
    assert set(texts_of(spark, [("http://a.example", wrapped.format(i)) for i in range(3)]).values()) == {"Text 0", "Text 1", "Text 2"}


def test_pipeline_keeps_one_row_of_each_group(spark):
    passage = next(r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect() if len(r["text"].split()) > 20)
    rows = [
        (None, "a clean text without an id"), (None, "another clean text, also without any id"), (None, "One two three four five"),
        (7, "one two three four five"), (8, "one two three four FIVE"), (8, "words of a second text on one id"),
        (9, "Words of a second text on one id"), (1, "a first text"), (1, "quite a different other thing"), (1, "a first text"),
        (None, "no id here nor there"), (None, "no id here nor there"), (None, passage), (20, passage + " z"), (20, "twenty is clean"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    kept = corpus_pipeline.near_dedup(spark, docs.repartition(5), FOLDER)
    assert kept.columns == corpus_pipeline.COLUMNS
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=order)
    away = [rows[2], rows[4], rows[6]]
    expected = sorted({r for r in rows if r not in away}, key=order)
    assert [g for g in got if g[1] not in (passage, passage + " z")] == [e for e in expected if e[1] not in (passage, passage + " z")]
    clean = corpus_pipeline.decontaminated(spark, docs, FOLDER)
    got = sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=order)
    assert got == sorted((r for r in rows if passage not in r[1]), key=order)


def all_segmentations(word, pieces, probabilities):
    """The sum over all segmentations by trying each, an unknown character as a piece of its own."""
    total = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(j):
            piece = word[i:j]
            p = probabilities.get(piece, 1e-7 if len(piece) == 1 else 0.0)
            total[j] += total[i] * p
    return total[-1]


def test_sums_over_words_and_pieces_of_any_length():
    rng = random.Random(6)
    pieces = sorted({"▁", "a", "b", "ab", "ba", "▁a", "abab", "a" * 14, "b" * 20, "▁" + "ab" * 9})
    probabilities = np.array([[rng.random() / 4, rng.random() / 4] for _ in pieces])
    segmenter = Segmenter(pieces)
    table = segmenter.table(probabilities)
    words = ["a", "ba", "abab", "x", "a" * 20, "ab" * 9, "b" * 31, "ab" * 16, "b" * 33, "ab" * 40, "axb" * 30]
    got = segmenter.log_probabilities(words, table)
    for i, word in enumerate(words):
        for lang in range(2):
            want = all_segmentations("▁" + word, pieces, dict(zip(pieces, probabilities[:, lang])))
            assert math.isclose(got[i, lang], math.log(want), rel_tol=1e-9)
            assert math.isclose(segmenter.long_word(word, table)[lang], math.log(want), rel_tol=1e-9)
    assert np.isfinite(segmenter.long_word("abx" * 3000, table)).all()
    # Uses of pieces, weighted by length, add up to the letters; the same with and without rescaling.
    for word in ("ab" * 15, "ab" * 60):
        uses = segmenter.expected([word], np.array([[1.0, 2.0]]), table)
        lengths = np.array([*map(len, pieces), 1, 0])
        assert np.allclose(lengths @ uses, np.array([1, 2]) * (len(word) + 1))


def test_texts_without_letters_and_rare_languages(spark):
    rng = random.Random(7)
    langs = {"aa": "kala tiro misu", "bb": "zweg brunf schti"}
    rows = [(i, " ".join(rng.choices(langs["aa"].split(), k=8)), "aa") for i in range(3000)]
    rows += [(5000 + i, " ".join(rng.choices(langs["bb"].split(), k=8)), "bb") for i in range(8)]
    rows += [(9001, "½ ² 12 _ !", "aa"), (9002, None, "bb"), (9003, "", None), (9004, "brunf zweg", None), (None, "kala", "aa")]
    rows += [(9005, "zwegbrunf" * 4000, None)]
    df = spark.createDataFrame([(*r, 0.1, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    got = {r["doc_id"]: r["lang_pred"] for r in languages(df, sample_rows=50).collect()}
    assert [got[i] for i in (9001, 9002, 9003)] == ["und"] * 3
    assert got[9004] == got[9005] == "bb" and got[None] == "aa"
    assert all(got[5000 + i] == "bb" for i in range(8))
    assert words_of("हिन्दी café ½") == ["हिन्दी", "café"]


def test_a_doc_id_on_many_rows_counts_once_in_the_fit(spark):
    docs = [(1, f"text {i}") for i in range(3000)] + [(i, f"Some good words here, {i}.") for i in range(2, 60)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    assert quality_scores(docs, labels).count() == docs.count()
