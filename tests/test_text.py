"""Literal-input checks of the text builders; independent Python code is the yardstick where there is one."""
import html

from pyspark.sql import functions as F

from siftwork.functions import text as tx


def one(values, build, *inputs):
    return values([(x,) for x in inputs], "s string", lambda df: build(df.s))


def test_canonical_url(values):
    got = one(values, tx.canonical_url,
              "https://www.Boards.greenhouse.io/acme/jobs/7?gh_src=abc&utm_source=Q&ref=Z", "http://boards.greenhouse.io/acme/jobs/7/",
              "https://x.org/jobs?lang=en&id=9", "x.org", "https://x.org/a//?b=&c=%20d~*&UTM_x=1#frag", "", None,
              "https://x.org/p?q=a+b&q=A&bad=%zz", "https://x.org/p?%62=1&a=2", "https://x.org/p?a=%7A&a=b")
    assert got == ["https://boards.greenhouse.io/acme/jobs/7"] * 2 + [
        "https://x.org/jobs?id=9&lang=en", "https://x.org/", "https://x.org/a?c=+d~%2A", "", None,
        "https://x.org/p?bad=%25zz&q=A&q=a+b", "https://x.org/p?a=2&b=1", "https://x.org/p?a=b&a=z"]


def test_slug_and_keys(values):
    assert one(values, tx.slug, "Vega, Inc.", "Blue Fir (Toronto)", "LLC", "Ünder Co.", "A-1 Labs") == [
        "vega", "blue-fir", "unknown", "nder", "a-1"]
    assert one(values, tx.company_key, "Flyzipline", "Zipline", None) == ["zipline", "zipline", "unknown"]


def test_titles_and_places(values):
    titles = one(values, tx.normalize_title, "Software Engineering Intern - Summer 2027", "Software Engineer Intern (Summer 2027)",
                 "Machine Learning Intern &amp; Co-op", "Systems Testers")
    assert titles == ["software engine", "software engine", "machine learn", "system tester"]
    assert one(values, tx.normalize_place, "New York, NY", "NYC", "Austin, TX; Seattle, WA", None, "Remote - US", "SF or LA",
               "Greater Oslo Area") == ["new york", "new york", "austin", "remote", "remote", "san francisco", "greater oslo"]


def test_text_hash_ignores_spacing(values):
    a, b, c, d = one(values, tx.text_hash, "a  b\n c", " a b c ", "", None)
    assert a == b and c is None and d is None


def test_unescape_matches_the_standard_library(values):
    cases = ["a &amp; b", "&lt;p&gt;", "&notit; &not", "&#8364;&#x20AC;", "&#150;", "&bogus; & &;", "&eacute&Eacute;",
             "&amp;amp;", "plain", "&CounterClockwiseContourIntegral;", "x&copy2024", "&#0;",
             "&amp" + "a" * 100 + ";", "&#x0000000000000041;", "&#1;x", "&#xFFFE;", "&#xFFFFFFFFFF;", "&#00065;"]
    assert one(values, tx.unescape, *cases) == [html.unescape(c) for c in cases]


def test_html_to_text(values):
    got = one(values, tx.html_to_text, "&lt;p&gt;Hi &amp;amp; bye&lt;/p&gt;&lt;ul&gt;&lt;li&gt;One&lt;/li&gt;&lt;/ul&gt;",
              "<div>a<br>b</div>\n\n\n<p> c  d </p>", None, "x <b>y</b>\r\nz")
    assert got == ["Hi & bye\n\nOne", "a\nb\n\nc d", "", "x y\nz"]


def test_boilerplate_cut_only_past_400(values):
    long = "x" * 410 + " Equal Opportunity employer"
    assert one(values, tx.trim_boilerplate, "We value equal opportunity\n\n\n\nok", long) == [
        "We value equal opportunity\n\nok", "x" * 410]


def test_match_windows_equal_finditer(values):
    import re
    text = "é pay unpaid x " + "unpaid " * 3 + "y" * 70 + " unpaid"
    want = [text[max(0, m.start() - 5): m.end() + 5] for m in re.finditer("unpaid", text)]
    assert one(values, lambda c: tx.match_windows(c, "unpaid", 5, 5), text, "none") == [want, []]


def test_boards(values):
    got = one(values, tx.board_from_url, "https://acme.wd5.myworkdayjobs.com/en-US/Site/job/x", "https://acme.wd5.myworkdayjobs.com/job/x",
              "https://job-boards.greenhouse.io/tok/jobs/1", "https://jobs.ashbyhq.com/a.b/1", "https://other.org")
    assert [tuple(g) if g else None for g in got] == [
        ("workday", "acme/wd5/Site"), None, ("greenhouse", "tok"), ("ashby", "a.b"), None]


def test_internship_titles(values):
    assert one(values, tx.looks_like_internship, "SWE Intern", "Internal Audit", "Co-op", "Coops", "Early-Career", None) == [
        True, False, True, True, True, False]


def test_compact_number(values):
    got = values([(7,), (1234,), (12_500,), (13_500,), (2_500_000,), (None,)], "n bigint", lambda df: tx.compact_number(df.n))
    assert got == ["7", "1.2K", "12K", "14K", "2.5M", "0"]


def test_role_vocabulary_is_whole(values):
    """Cases the original states for titles and vocabulary."""
    from siftwork.config import Settings
    from siftwork.functions import roles
    rows = [("Quantitative Trading Intern", "Nobody Inc"), ("Quantitative Developer Intern", "Optiver"), ("Quantitative Software Engineer Intern", "Citadel"), ("Linux Engineer Intern", "Jane Street")]
    found = values(rows, "title string, company string", lambda df: roles.classify(Settings(), F.col("title"), F.col("company")))
    assert found == ["quantresearch", "quantresearch", "quant", "quant"]
    words = {t.key: t.keywords for t in Settings().catalog}
    assert "slam" in words["robotics"] and sum(map(len, words.values())) == 424
