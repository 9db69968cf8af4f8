"""Tag-path ratios without names, captions and short quotes, markup that never closes."""

import re
import time

import pyarrow.parquet as pq
import pytest

from seamline.llm.html_text import main_text

P = "<p>The long story begins here, with many words in its first sentence, and more to come.</p>"
SAID = "The long story begins here, with many words in its first sentence, and more to come."


@pytest.mark.parametrize("tag", ["article", "div"])
def test_captions_and_short_quotes_stay(tag):
    page = f"<body><nav><ul><li>Home</li></ul></nav><{tag}>{P * 3}<figure><img src=x><figcaption>A boat</figcaption></figure><blockquote>Yes</blockquote>{P}</{tag}><footer>c</footer></body>"
    assert main_text(page) == " ".join([SAID] * 3 + ["A boat Yes", SAID])


def test_ratios_decide_without_names():
    """Of 1,000 pages, with class, id and role taken away and article turned into div, at least 900 keep their text."""
    pages = pq.read_table("/root/testdata/sf0.1/pages.parquet", columns=["html"]).column("html").to_pylist()[:1000]
    bare = [re.sub(r"<(/?)article\b", r"<\1div", re.sub(r"\s(?:class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", p)) for p in pages]
    assert sum(b != p for b, p in zip(bare, pages, strict=True)) > 900
    assert sum(main_text(b) == main_text(p) for b, p in zip(bare, pages, strict=True)) >= 900


@pytest.mark.parametrize("part", ['<a "', '<a " ', '<a ">" ', '<a x=">" ', "<a '", "<script></script", "<aaa", "<!--", "<", '<p class="', "<a \"<a '", "<div>"])
def test_a_megabyte_of_open_markup(part):
    start = time.time()
    main_text(part * (1_000_000 // len(part)))
    assert time.time() - start < 5


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<p>One, two.<a title="a > b" href="/x">three</a> four.</p>', "One, two.three four."),
        ("<p>One, two. <a title=\"it's\">three</a> four.</p>", "One, two. three four."),
        ('<p>One, two. <b title="open>three</b> four.</p>', "One, two. three four."),
        ("<p>One < two, and so on", "One < two, and so on"),
        ("<p>One, two.</p><a href=", "One, two."),
        ("<p>One, two.</p><script>x</script><p>Three, four.</p><script>y", "One, two. Three, four."),
        ("<p>One<!-- <p> -->, two.<!-- rest", "One, two."),
        ("", ""),
        (None, ""),
    ],
)
def test_markup(page, want):
    assert main_text(page) == want
