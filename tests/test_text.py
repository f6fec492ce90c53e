"""Text columns against Python's own HTML and case-folding rules."""

import html
import random
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from rolecast.functions import text


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r.v for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_unescape_follows_html5(spark):
    cases = [
        "&amp;lt;b&amp;gt; &notit; &ampfoo &#65;&#x41;&#0;&#128;&#xD800;&#99999999999;&#xFEFF;x",
        "&nbsp;&hellip;&bogus; &lt &copy2 & &; &#; &#x; &NotEqualTilde;",
        "plain", "&", "a&&b", "&#1;&#x110000;&#00000000065;&lang;&Lang;&AMP", "&notin;&notinx;&no",
    ]
    random.seed(3)
    pool = ["&", "amp", ";", "lt", "#", "x", "41", "not", "it", " ", "é", "quot;", "&#8217;"]
    cases += ["".join(random.choices(pool, k=9)) for _ in range(300)]
    assert values(spark, cases, text.unescape) == [html.unescape(c) for c in cases]


def test_fold_case_is_full_folding(spark):
    cases = ["Straße ΣΊΣΥΦΟΣ ς ﬁn ŉ İ K ſ µ ẞ ᾳ", "ABC", "", "ꭰ և ǰ ΐ", "😀ﬁ𝐀ǰ😀"]
    assert values(spark, cases, text.fold_case) == [c.casefold() for c in cases]
    assert values(spark, [None], text.fold_case) == [""]


def test_match_key(spark):
    assert values(spark, ["Zürich & Co.", "  A--b ", None, "u.s."], text.match_key) == ["z rich and co", "a b", "", "u s"]


class _Walk(HTMLParser):
    """Independent statement of the tag rules for well-formed input."""

    def __init__(self):
        super().__init__()
        self.out = []

    def handle_starttag(self, tag, attrs):
        self.out.append("\n- " if tag == "li" else "\n" if tag in text.BLOCK_TAGS else "")

    def handle_endtag(self, tag):
        self.out.append("\n" if tag in text.BLOCK_TAGS else "")

    def handle_data(self, data):
        self.out.append(data)


def _tidy(raw):
    raw = html.unescape(raw).replace(text.MOJIBAKE_BULLET, "-").replace("•", "-").replace("\xa0", " ")
    for pattern, new in ((r"\s*/\s*", "/"), (r"[ \t\r\f\v]+", " "), (r"\n\s*\n+", "\n"), (r" *\n *", "\n")):
        raw = re.sub(pattern, new, raw)
    return raw.strip()


def test_html_text_matches_a_parser(spark):
    random.seed(5)
    pool = [
        "<p>", "</p>", "<li class='a>b'>", "</li>", "<br/>", "<B>", "</B>", "<!-- x<p> -->", "<h2 id=\"q\">", "</h2>",
        "a / b", "x &amp;amp; y", " \n\n ", "•", "&lt;p&gt;", "é\u00a0z", "<tr><td>", "1 < 2 ", "<li/>", "&#8226;",
        "<script>if (a<b) \"</p>\"</script>", "<STYLE>p{}</STYLE>", "\t\t", "â\u0080¢",
    ]
    cases = ["".join(random.choices(pool, k=12)) + "<i>." for _ in range(200)]
    expected = []
    for case in cases:
        walk = _Walk()
        walk.feed(html.unescape(case))
        walk.close()
        expected.append(_tidy("".join(walk.out)))
    assert values(spark, cases, text.html_text) == expected


def test_html_text_keeps_tail_and_can_drop_scripts(spark):
    assert values(spark, ["AT&T", "a <b", None, ""], text.html_text) == ["AT&T", "a <b", "", ""]
    drop = lambda c: text.html_text(c, drop_scripts=True)
    assert values(spark, ["a<script>x</script>b<style>y</style>"], drop) == ["ab"]
    assert values(spark, ["a<script>x</script>b"], text.html_text) == ["axb"]


def test_description_without_cue_keeps_everything(spark):
    assert values(spark, ["<p>Hello</p><p>World</p>"], text.description_text) == ["Hello\nWorld"]


def test_description_every_cue(spark):
    starts = ["Job Description Summary:", "What you will be doing:", "What you'll be doing:", "WHAT YOU’LL BE DOING:", "Responsibilities", "responsibilities:"]
    cases = [f"<p>intro</p><p>{s} work here</p><p>more</p>" for s in starts]
    assert values(spark, cases, text.description_text) == ["work here\nmore"] * len(starts)
    stops = ["Additional Job Description", "The US base salary range", "The U.S. base salary range", "equal opportunity employer", "E-Verify", "Connect With", "Explore life at", "Reasonable accommodation"]
    cases = [f"<p>work</p><p>{s} boilerplate</p>" for s in stops]
    assert values(spark, cases, text.description_text) == ["work"] * len(stops)


def test_description_cue_order_and_labels(spark):
    # list order beats text position, and the later cue never gets its turn
    one = "Responsibilities: first Job Description Summary: second"
    two = "Duties/Responsibilities: lift. Experience 5 years, experience: many. Skills/Abilities x. Education y"
    assert values(spark, [one, two], text.description_text) == [
        "second",
        "lift. Experience: 5 years, Experience: many. Skills & Abilities: x. Education: y",
    ]


def test_description_custom_cues(spark):
    clean = lambda c: text.description_text(c, [r"\bBegin\b"], [r"\bEnd\b|\bFin\b"])
    assert values(spark, ["x begin mid fin tail", "no cue"], clean) == ["mid", "no cue"]


def test_digest_is_null_without_cue(spark):
    digest = lambda c: text.digest_tidy(text.digest_cut(c))
    cases = ["a What you will be doing: x\n y / z  Job Location q", "nothing", None]
    assert values(spark, cases, digest) == ["x y/z", None, None]


def test_split_overviews(spark):
    assert values(spark, ["x Overview: Draper one overview:  draper two"], text.split_overviews) == [
        ["x", "Overview: Draper one", "overview:  draper two"]
    ]
