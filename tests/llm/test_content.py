import random
import re
from collections import Counter

import pytest

from rolecast.llm import html_text, langid, licenses, quality
from tests.llm.cases import ODD, fold, frame

SMALL = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


# --- licences -----------------------------------------------------------------------


@pytest.mark.parametrize(
    ("expression", "licences", "freedom"),
    [
        ("MIT", ["mit"], 1.0),
        ("MIT AND GPL-2.0-only", ["mit", "gpl-2.0-only"], 0.3),
        ("MIT OR GPL-2.0-only", ["mit", "gpl-2.0-only"], 1.0),
        ("GPL-2.0-only OR MIT AND Proprietary", ["gpl-2.0-only", "mit", "proprietary"], 0.3),
        ("(GPL-2.0-only OR MIT) AND Proprietary", ["gpl-2.0-only", "mit", "proprietary"], 0.0),
        ("GPL-2.0-only WITH Classpath-exception-2.0", ["gpl-2.0-only"], 0.65),
        ("MIT AND GPL-2.0-only WITH X OR Reserved", ["mit", "gpl-2.0-only", "reserved"], 0.65),
    ],
)
def test_expressions(expression, licences, freedom):
    assert licenses.evaluate(expression) == (licences, pytest.approx(freedom))


@pytest.mark.parametrize("expression", ["", "MIT AND", "AND MIT", "(MIT", "MIT)", "MIT GPL", "()", "(MIT OR X) WITH Y"])
def test_faulty_expressions(expression):
    assert licenses.evaluate(expression) is None


def plain_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_places_of_phrases(spark):
    rows = ODD + [
        (300, "All Rights Reserved. all rights, reserved; CC-BY cc by by"),
        (301, "the GNU General Public License General public license"),
        (302, "ends with cc by"),
        (303, "ccby all rights unreserved"),
    ]
    found = licenses.scan(frame(spark, rows)).collect()
    got = [(str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found]
    assert sorted(got, key=repr) == sorted([(str(i), *plain_places(t)) for i, t in rows], key=repr)
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} for r in found)
    documents = table(spark, "documents")
    whole = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(documents).collect()}
    assert whole == {r.doc_id: plain_places(r.text) for r in documents.collect()}
    assert licenses.scan(frame(spark, [])).count() == 0


def test_tags(spark):
    text = "/* SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause */\n# spdx-license-identifier: broken AND\nx"
    row = licenses.scan(frame(spark, [(1, text)])).first()
    assert row.labels == "apache-2.0,bsd-3-clause,mit"
    assert row.expressions == "(mit or apache-2.0) and bsd-3-clause"
    assert (row.score, row.freedom) == (0.985, 1.0)  # "bsd 3 clause" is a notice as well


# --- pages --------------------------------------------------------------------------

LABELLED = "<body><nav><a href=x>Home</a> <a>News</a></nav><article><h1>T</h1>{}</article><footer>&copy; all</footer></body>"
PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="no-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href="/a">One</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="content"><h1>Head &amp; line</h1><p>First <b>par</b>agraph &lt;here&gt;,
   with   space and quite some words in it.</p><div class="ad">Buy now</div><form><input> Your mail</form>
<p>Second paragraph&nbsp;of the page, also with many words in it.<br>After a break.</p><!-- <p>no</p> -->
<div id="comments"><p>Nice text, thank you</p></div></div><aside>Other things</aside><footer>The end</footer></body></html>"""
WANTED = (
    "Head & line\nFirst paragraph <here>, with space and quite some words in it.\n"
    "Second paragraph of the page, also with many words in it. After a break."
)


def pages(spark, sources):
    rows = [(i, f"http://x/{i}", s, "clash", 1) for i, s in enumerate(sources)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")


def test_main_text(spark):
    sources = [LABELLED.format(f"<p>{'some words in a row ' * 9}</p>" * 3), PAGE, None, "", "<p", "a < b", "<nav>" * 5000, "<p>" + "word " * 60_000]
    sources += [LABELLED.split("{}")[0] + "<p>cut off in the mid", "<article><p>never closed &am"]
    found = html_text.extract(pages(spark, sources), html_text.fit(pages(spark, sources))).orderBy("page_id").collect()
    texts = [r.text for r in found]
    assert texts[0] == "T\n" + "\n".join([("some words in a row " * 9).strip()] * 3)
    assert texts[1] == WANTED
    assert texts[2:5] == ["", "", ""]
    assert texts[6] == ""
    assert len(texts[7].split()) == 60_000
    assert texts[8] == "T\ncut off in the mid"
    assert texts[9] == "never closed &am"
    assert [r.n_chars for r in found] == [len(t) for t in texts]
    assert html_text.extract(pages(spark, []), html_text.fit(pages(spark, []))).count() == 0


@pytest.mark.parametrize(
    "odd",
    [
        '<img class="social-icon" src=x>',
        '<hr class="footer-line">',
        '<p><input class="search"></p>',
        '<p class="notice">gone',
        '<ul><li class="share">gone<li>Kept</ul>',
        '<div><span class="share">gone</div>',
        '<table><tr><td class="ad">gone<td>Kept</table>',
        "<svg-icon></svg-icon>",
        '<svg class="x" d="1"/>',
        "<object-card></object-card>",
    ],
)
def test_the_rest_of_a_page_stays(odd):
    words = "Many words that are the text of the page. " * 5
    for page in (f"<body><article><p>{words}</p>{odd}<p>Behind it. {words}</p></article>", f"<body><p>{words}</p>{odd}<p>Behind it. {words}</p>"):
        text = html_text.Page(page).main_text(html_text.Weights({}))
        assert "Behind it." in text and "gone" not in text
        assert ("Kept" in odd) == ("Kept" in text)


@pytest.mark.parametrize(
    "block",
    [
        '<h2 id="related-work">{}</h2>',
        '<h2 id="how-to-share-data">{}</h2>',
        '<section id="discussion"><p>{}</p></section>',
        '<section id="social-impact"><p>{}</p></section>',
        '<div class="search-engines">{}</div>',
        '<p><a title="a hidden gem">{}</a></p>',
        '<div class="row hidden md-block">{}</div>',
        "<p><math><mi>{}</mi></math></p>",
    ],
)
def test_blocks_of_an_article_stay(block):
    words = "Many words that are the text of the page. " * 5
    inner = f"<p>{words}</p>{block.format('This is kept.')}<p>{words}</p>"
    for page in (f"<article>{inner}</article>", f"<body>{inner}</body>"):
        assert "This is kept." in html_text.Page(page).main_text(html_text.Weights({}))


def test_every_count_of_made_up_tags_is_kept(spark):
    sources = ["<article>" + "".join(f"<x-{i}-{k}>word</x-{i}-{k}>" for k in range(600)) + "</article><p>out</p>" for i in range(20)]
    weights = html_text.fit(pages(spark, sources))
    kinds = {k for k in weights.known if k[0] == "<"}
    assert kinds == {"<other>", "<article>", "<p>"}
    assert weights.known["<other>"] == -html_text.LEAST  # all of them were inside


def test_the_innermost_content_bounds_the_text():
    words = ("Words of the text. " * 30).strip()
    page = f"<main><div class='col-3'><a>links here</a> <a>more links</a></div><article><h1>T</h1><p>{words}</p></article></main>"
    assert html_text.Page(page).main_text(html_text.Weights({})) == f"T\n{words}"


FEW = " ".join(f"word{i}" for i in range(67))
MORE = " ".join(f"term{i}" for i in range(68))


@pytest.fixture(scope="module")
def learned(spark):
    return html_text.fit(table(spark, "pages"))


@pytest.mark.parametrize("fitted", [True, False])
def test_nothing_of_an_article_is_lost(learned, fitted):
    weights = learned if fitted else html_text.Weights({})
    rows = "".join(f"<tr><td>cell {i}</td><td>value {i}</td></tr>" for i in range(40))
    cells = [f"{kind} {i}" for i in range(40) for kind in ("cell", "value")]
    both = f"<p>{FEW}</p><p>{MORE}</p>"
    for page, want in [
        (f"<body><main><article><p>{FEW}</p></article><article><p>{MORE}</p></article></main></body>", [FEW, MORE]),
        (f"<body><article><p>{FEW}</p></article><article><p>{MORE}</p></article></body>", [FEW, MORE]),
        (f"<body><article><p>{FEW}</p><table>{rows}</table><p>{MORE}</p></article></body>", [FEW, *cells, MORE]),
        (f"<body><p>{FEW}</p><table>{rows}</table><p>{MORE}</p></body>", [FEW, *cells, MORE]),
        (f'<body><nav>a b</nav><div class="page-search">{both}</div></body>', [FEW, MORE]),
        (f'<body><div class="elementor widget">{both}</div></body>', [FEW, MORE]),
        (f'<body><div class="widget-wrap">{both}</div></body>', [FEW, MORE]),
        (f"<body><form>{both}<input></form><footer>x</footer></body>", [FEW, MORE]),
        (f"<body><h1>T</h1><div><p>{FEW}</p></div></body>", ["T", FEW]),
        (f"<article><p>Press the <button>Start</button> key. {FEW}</p></article>", [f"Press the Start key. {FEW}"]),
    ]:
        assert html_text.Page(page).main_text(weights).split("\n") == want, page[:80]


@pytest.mark.parametrize(
    "furniture",
    [
        "<section id=comments><p>gone one two three</p></section>", '<div id="disqus_thread">gone x y</div>', '<div class="comment-body">gone x y</div>',
        '<div class="adsbygoogle">gone x</div>', '<div class="top-ad-300x250">gone a b</div>', '<div class="newsletter-signup-cta">gone x</div>',
        '<div class="gdpr-bar">gone x</div>', '<div class="share-this-post">gone</div>', "<div id=sidebar>gone q</div>", "<form>gone <input></form>", "<aside>gone</aside>",
    ],
)
def test_furniture_inside_the_text_goes(learned, furniture):
    for weights in (learned, html_text.Weights({})):
        for page in (f"<article><p>{FEW}</p>{furniture}<p>{MORE}</p></article>", f"<body><p>{FEW}</p>{furniture}<p>{MORE}</p></body>"):
            assert html_text.Page(page).main_text(weights) == f"{FEW}\n{MORE}"


def test_the_best_run_is_the_best_of_all_runs():
    rng = random.Random(8)
    for _ in range(300):
        page = html_text.Page("")
        n = rng.randrange(1, 14)
        page.kinds = [rng.choice(["w", "<p>", "<div>", "link"]) for _ in range(n)]
        page.sizes = [rng.randrange(1, 4) if k in ("w", "link") else 1 for k in page.kinds]
        value = {"w": 1.0, "<p>": -0.5, "<div>": -2.0, "link": 0.25}
        low, high = page.best_run(value.get)
        every = [(sum(value[k] * s for k, s in zip(page.kinds[a:b], page.sizes[a:b], strict=True)), a, b) for a in range(n) for b in range(a + 1, n + 1)]
        best = max(x[0] for x in every)
        got = sum(value[k] * s for k, s in zip(page.kinds[low:high], page.sizes[low:high], strict=True))
        assert got == pytest.approx(max(best, 0.0))


def test_repeated_and_null_page_ids(spark):
    rows = [(1, "u", f"<p>{FEW}</p>", None, None), (1, "v", f"<p>{MORE}</p>", None, None), (None, None, f"<p>{FEW}</p>", None, None)]
    given = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = html_text.extract(given, html_text.Weights({})).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text) for r in got) == [(0, "", FEW), (1, "u", FEW), (1, "v", MORE)]


def test_without_labelled_pages(spark):
    found = html_text.extract(pages(spark, [PAGE]), html_text.fit(pages(spark, [PAGE]))).first()
    assert found.text == WANTED


def test_furniture_by_name(spark):
    page = """<body><div id="header">Top</div><div class="site-header">Name of it</div><div class="content has-sidebar"><div class="entry-header">
    <h1>The headline of it</h1></div><p>Some words of the article that are many enough.</p><p class="alert notice">A notice</p>
    <section class="reader-comments"><p>I like it very much, thank you all</p></section><div hidden>Not seen by readers</div>
    <ul><li>One of the points</li><li>The other point &#233; &eacute;</li></ul></div><div class="right-rail"><p>More words at the side</p></div></body>"""
    found = html_text.extract(pages(spark, [page]), html_text.fit(pages(spark, [page]))).first()
    assert found.text == (
        "The headline of it\nSome words of the article that are many enough.\nOne of the points\nThe other point é é"
    )


def test_given_pages(spark):
    """Pages of the test table hold their text in one article of simple blocks."""
    given = table(spark, "pages")
    found = {r.page_id: r.text for r in html_text.extract(given, html_text.fit(given)).collect()}
    for r in given.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        inner = re.sub(r"<[^>]*\Z", "", re.sub(r"</?b>|<br>", " ", inner))
        blocks = (" ".join(html_text.html.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert found[r.page_id] == "\n".join(b for b in blocks if b)


# --- languages ----------------------------------------------------------------------


def test_held_out_accuracy(spark):
    docs = table(spark, "documents")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where(langid.remainder() == 1).collect()
    assert len(found) > 250
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.98
    assert sum(r.rejected for r in found) == 0
    assert all(0 <= r.score <= 1 for r in found)


def test_languages_of_odd_rows(spark):
    docs = table(spark, "documents")
    model = langid.fit(langid.learnable(docs))
    rows = {str(r.doc_id): r for r in langid.predict(frame(spark), model).collect()}
    for i in ("3", "4", "5", "12", "13"):
        assert (rows[i].lang_pred, rows[i].score, rows[i].rejected) == ("und", 0.0, True)
    assert rows["6"].lang_pred == "en"
    junk = frame(spark, [(1, "xq zzkw vvbnm qqq jkjkx wwxz " * 20), (2, "the of and to in that is for with")])
    assert [r.rejected for r in langid.predict(junk, model).orderBy("doc_id").collect()] == [True, False]
    assert [r.doc_id for r in langid.accepted(junk, model).collect()] == [2]
    assert langid.accepted(frame(spark), model).columns == frame(spark).columns


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.identify(docs).first().lang_pred == "und"
    assert langid.identify(docs.where("false")).count() == 0


def test_probabilities_of_a_context_add_up():
    import numpy as np

    texts = Counter("abracadabra abraham cadabra bar")
    letters = langid.letters()
    code, _, _ = letters.read(["abracadabra abraham cadabra bar" * 3])
    keys, counts = np.unique(langid.grams(code, 3, len(code)), return_counts=True)
    model = langid.KneserNey(keys, counts, int((counts == 1).sum()), int((counts == 2).sum()))
    alphabet = sorted({ord(c) for c in texts})
    contexts = np.unique(keys >> np.uint64(16))
    for context in contexts:
        row = np.array([(int(context) << 16) | a for a in alphabet], np.uint64)
        assert 0.9 < np.exp2(model.log2(row)).sum() <= 1.0 + 1e-9


# --- quality ------------------------------------------------------------------------


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, same = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            same += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), same, len(covered), failed


def test_base_rules(spark):
    rows = [*ODD, (400, "a b c d e f " * 3 + "# | <x>"), (401, "one two three four five six\n" * 2 + "\n \n x y z"), (402, "a a a a a a a b")]
    model = quality.Model()
    found = quality.assess(frame(spark, rows), model).collect()
    got = [(str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found]
    assert sorted(got) == sorted((str(i), *plain_base(t)) for i, t in rows)
    assert all(r.kept == (not r.base_failed) for r in found)
    docs = table(spark, "documents")
    whole = {r.doc_id: tuple(r[1:7]) for r in quality.assess(docs, model).collect()}
    assert whole == {r.doc_id: plain_base(r.text) for r in docs.collect()}


def test_verdicts_on_rows_not_learned_from(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    found = quality.assess(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").drop("quality")
    rows = quality.assess(docs, model).select("doc_id", "base_failed", "kept").join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    judged = [r for r in rows if not r.base_failed]
    assert found.count() == len(rows) and len(judged) > 100
    assert sum(r.kept == bool(r.quality) for r in judged) / len(judged) > 0.97


def test_quality_without_labels(spark):
    docs = frame(spark)
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality long"))
    assert not model.fitted
    assert quality.accepted(docs, model).count() == sum(not plain_base(t)[5] for _, t in ODD)
    assert quality.assess(frame(spark, []), model).count() == 0


def test_all_sequences_are_kept(spark):
    random.seed(2)
    rows = [(i, "".join(chr(random.randrange(0x4E00, 0x9F00)) for _ in range(5_000))) for i in range(100)]
    learned = spark.createDataFrame([(t, "zh") for _, t in rows], "text string, lang string")
    model = langid.fit(learned, calibration_rows=0)
    wanted = {("   " + t)[k : k + 4] for _, t in rows for k in range(len(t))}
    assert len(model.parts[0].levels[0][0].hashes) == len(wanted) > 400_000


@pytest.mark.parametrize(
    ("line", "labels"),
    [
        ("SPDX-License-Identifier: MIT OR Apache-2.0 see below", "apache-2.0,mit"),
        ("# spdx-license-identifier: MIT and see the file", "mit"),
        ("SPDX-License-Identifier: (MIT", "mit"),
        ("SPDX-License-Identifier: LicenseRef-foo_bar", "licenseref-foo_bar"),
        ("SPDX-License-Identifier: DocumentRef-x:LicenseRef-y AND GPL-2.0+ */", "documentref-x:licenseref-y,gpl-2.0+"),
        ("SPDX-License-Identifier: (MIT OR (ISC AND Zlib", "mit"),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0.", "gpl-2.0-only"),
        ("SPDX-License-Identifier: MIT WITH (ISC OR Zlib)", "mit"),
        ("License: MIT", "mit"),
        ('"license": "BSD-3-Clause",', "bsd-3-clause"),
        ("licence = Apache-2.0", "apache-2.0"),
        ("The license: it is not said", ""),
        ("SPDX-License-Identifier: none of these", ""),
        ("SPDX-License-Identifier:", ""),
        ("Distributed under the Boost Software License, Version 1.0.", "bsl-1.0"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
        ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ],
)
def test_tags_and_notices_give_what_is_well_formed(spark, line, labels):
    found = licenses.Scanner().scan(f"text before\n{line}\ntext behind")
    assert found[5] == labels and (found[6] > 0) == bool(labels)


def test_tag_lines_of_a_table(spark, tmp_path):
    rows = [(1, "a\n// SPDX-License-Identifier: MIT OR GPL-2.0-only\nb"), (2, None), (3, "License: CC0-1.0\nall rights reserved"), (4, "no licence here")]
    frame(spark, rows, False).write.parquet(f"{tmp_path}/documents.parquet")
    from rolecast.llm.queries import REGISTERED

    got = {r.doc_id: r for r in REGISTERED["op1_licenses"](spark, str(tmp_path)).collect()}
    assert [got[i].labels for i in (1, 2, 3, 4)] == ["gpl-2.0-only,mit", "", "cc0-1.0,reserved", ""]
    assert got[1].expressions == "mit or gpl-2.0-only" and got[1].freedom == 1.0
    assert got[3].base_labels == "reserved" and got[4].score == 0
