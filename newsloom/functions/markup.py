"""Escaping, Markdown and HTML as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import JS_CHAR, JS_LINE_END, JS_LINE_START, JS_SPACE, JS_SPACES, strip

# Replacements in the order they apply; the ampersand comes first.
HTML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
XML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))

# Entities resolved when text is taken out of a page; the ampersand comes last.
PAGE_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", " "), ("&amp;", "&"),
)


def _replace_all(c: Column, pairs) -> Column:
    return reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), pairs, c)


def _rewrite(c: Column, rules) -> Column:
    return reduce(lambda text, rule: F.regexp_replace(text, rule[0], rule[1]), rules, c)


def escape_html(c: Column) -> Column:
    return _replace_all(F.coalesce(c, F.lit("")), HTML_ESCAPES)


def escape_xml(c: Column) -> Column:
    return _replace_all(F.coalesce(c, F.lit("")), XML_ESCAPES)


def cdata(c: Column) -> Column:
    """CDATA section; an inner end mark is split over two sections."""
    return F.concat(F.lit("<![CDATA["), F.replace(c, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


# Fixed patterns of the Markdown subset.
_BOLD = rf"\*\*({JS_CHAR}+?)\*\*"
_ITALIC = rf"\*({JS_CHAR}+?)\*"
_CODE = rf"`({JS_CHAR}+?)`"
_LINK = rf"\[({JS_CHAR}+?)\]\({JS_CHAR}+?\)"


_PLAIN_RULES = (
    (rf"#{{1,6}}{JS_SPACE}+", ""),
    (_BOLD, "$1"),
    (_ITALIC, "$1"),
    (_CODE, "$1"),
    (_LINK, "$1"),
)
# Line ends other than the line feed; a text that holds one is rewritten as a whole.
_OTHER_ENDS = ("\r", "\u2028", "\u2029")


def _any_of(c: Column, marks) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(m)) for m in marks])


def _bare(c: Column) -> Column:
    """White space at the end dropped. Spark's trim walks the whole text, so it is called only where there is some."""
    ends = reduce(lambda a, b: a | b, [F.endswith(c, F.lit(s)) for s in JS_SPACES])
    return F.when(ends, F.rtrim(c, F.lit(JS_SPACES))).otherwise(c)


def _stripped(c: Column) -> Column:
    return F.ltrim(_bare(c), F.lit(JS_SPACES))


def _let(value: Column, body) -> Column:
    """`body(value)` with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_markdown(c: Column) -> Column:
    """Plain text of the Markdown subset on one line.

    The patterns stay inside a line, but for the white space after a heading mark, so they are applied
    line by line, and only where a mark occurs. A text with a line that ends in a heading mark, or with
    other line ends, is rewritten as a whole.
    """
    def rewritten(text: Column) -> Column:
        whole = _rewrite(text, (*_PLAIN_RULES, (r"\n+", " ")))
        return F.when(_any_of(text, _OTHER_ENDS), whole).otherwise(_let(
            F.filter(F.split(text, "\n", -1), lambda line: line != ""),
            lambda lines: F.when(F.exists(lines, _heading_mark_last), whole).when(_any_of(text, "#*`["), F.array_join(_plain_lines(lines), " ")).otherwise(F.array_join(lines, " "))))

    # `_stripped` names its text for each kind of white space, and inside a lambda Spark shares no work between them.
    return _let(_let(F.coalesce(c, F.lit("")), rewritten), _stripped)


def _heading_mark_last(line: Column) -> Column:
    return F.contains(line, F.lit("#")) & F.endswith(_bare(line), F.lit("#"))


def _plain_lines(lines: Column) -> Column:
    """The patterns in their order, each on the lines that hold its mark; most lines with stars are bold as a whole."""
    heading, bold, italic, code, link = _PLAIN_RULES

    def starred(line: Column) -> Column:
        inner = F.substring(line, F.lit(3), F.length(line) - 4)
        whole = F.startswith(line, F.lit("**")) & F.endswith(line, F.lit("**")) & (inner != "") & ~F.contains(inner, F.lit("*"))
        return F.when(whole, inner).otherwise(_rewrite(line, (bold, italic)))

    def where(mark: str, rule):
        return lambda line: F.when(F.contains(line, F.lit(mark)), rule(line)).otherwise(line)

    def by(*rules):
        return lambda line: _rewrite(line, rules)

    for mark, rule in (("#", by(heading)), ("*", starred), ("`", by(code)), ("[", by(link))):
        lines = F.transform(lines, where(mark, rule))
    return lines


def excerpt(c: Column, limit: int = 155) -> Column:
    """Plain text, cut to `limit` characters of which the last is an ellipsis.

    The first lines are rewritten first. No pattern reaches over a line feed, but for the white space after a
    heading mark, so they are the start of the whole plain text, which is needed only where they are too short.
    """
    text = F.coalesce(c, F.lit(""))
    return _let(_let(text, lambda whole: F.aggregate(
        F.array(_first_lines(whole, 4 * limit), whole), F.lit(""),
        lambda plain, part: F.when(F.length(plain) > limit, plain).otherwise(strip_markdown(part)),
    )), lambda plain: F.when(
        F.length(plain) > limit, F.concat(F.substring(plain, 1, limit - 1), F.lit("…"))
    ).otherwise(plain))


def _first_lines(text: Column, size: int) -> Column:
    """Whole lines of at least `size` characters from the start; empty if the text has no such, or a heading mark ends them."""
    end = F.call_function("locate", F.lit("\n"), text, F.lit(size + 1))
    return F.when(end > 0, _let(F.substr(text, F.lit(1), end - 1), lambda lines: F.when(
        ~F.endswith(F.rtrim(lines, F.lit(JS_SPACES)), F.lit("#")), lines).otherwise(""))).otherwise("")


def markdown_to_html(c: Column) -> Column:
    """Headings, bold, italic, code, lists and paragraphs.

    Bold and italic apply before list items, and a list takes in the newline after its last
    item, so a heading right after a list stays in the block of the list. All rules but the one that
    joins list items are rules of a line, and are applied where its marks occur; a text with a list
    mark alone on a line, or with other line ends, is rewritten as a whole.
    """
    def rewritten(text: Column) -> Column:
        whole = F.regexp_replace(_rewrite(text, _LINE_RULES), _ITEMS, "<ul>$1</ul>")
        return F.when(_any_of(text, _OTHER_ENDS), whole).otherwise(_let(
            F.split(text, "\n", -1), lambda lines: F.when(F.exists(lines, _mark_alone), whole).otherwise(by_line(lines))))

    def by_line(lines: Column) -> Column:
        for rule in (_line_start, _line_marks, _line_code, _line_item):
            lines = F.transform(lines, rule)
        return _let(lines, _joined_lines)

    escaped = _replace_all(F.coalesce(c, F.lit("")), HTML_ESCAPES[:3])
    # More than two line feeds end a block as well; blocks are stripped, and empty ones go.
    blocks = F.transform(F.split(_let(escaped, rewritten), "\n\n", -1), _stripped)
    return F.array_join(F.transform(F.filter(blocks, lambda block: block != ""), _paragraph), "\n")


def _is_item(line: Column) -> Column:
    return F.endswith(line, F.lit("</li>"))


def _joined_lines(lines: Column) -> Column:
    """The lines as a text, with each run of list items in a list that takes in the line feed behind it."""
    before = F.concat(F.array(F.lit("")), F.slice(lines, F.lit(1), F.size(lines) - 1))
    after = F.slice(lines, F.lit(2), F.size(lines))
    opened = F.zip_with(lines, before, lambda line, last: F.when(_is_item(line) & ~_is_item(last), F.concat(F.lit("<ul>"), line)).otherwise(line))
    ended = F.zip_with(opened, after, lambda line, following: F.concat(
        line,
        F.when(following.isNull(), "").otherwise("\n"),
        F.when(_is_item(line) & ~F.coalesce(_is_item(following), F.lit(False)), "</ul>").otherwise("")))
    return F.array_join(ended, "")


def _mark_alone(line: Column) -> Column:
    """Whether a line is a list mark and white space."""
    bare = F.ltrim(line, F.lit(JS_SPACES))
    return (F.startswith(bare, F.lit("-")) | F.startswith(bare, F.lit("*"))) & (F.ltrim(F.substr(bare, F.lit(2)), F.lit(JS_SPACES)) == "")


def _line_start(line: Column) -> Column:
    """A line that is all bold ends its block; headings."""
    def heading(mark: str, tag: str) -> Column:
        return F.concat(F.lit(f"<{tag}>"), F.substr(line, F.lit(len(mark) + 1)), F.lit(f"</{tag}>"))

    found = F.when(F.startswith(line, F.lit("**")), _let(_bare(line), lambda bare: _bold_line(bare, line)))
    for mark, tag in (("### ", "h3"), ("## ", "h2"), ("# ", "h2")):
        found = found.when(F.startswith(line, F.lit(mark)) & (line != mark), heading(mark, tag))
    return found.otherwise(line)


def _bold_line(bare: Column, line: Column) -> Column:
    inner = F.substring(bare, F.lit(3), F.length(bare) - 4)
    simple = F.when(F.contains(inner, F.lit("*")), bare).otherwise(F.concat(F.lit("<strong>"), inner, F.lit("</strong>")))
    return F.when(F.endswith(bare, F.lit("**")) & (F.length(bare) > 4), F.concat(simple, F.lit("\n\n"))).otherwise(line)


def _line_marks(line: Column) -> Column:
    return F.when(F.contains(line, F.lit("*")), _rewrite(line, ((_BOLD, "<strong>$1</strong>"), (_ITALIC, "<em>$1</em>")))).otherwise(line)


def _line_code(line: Column) -> Column:
    return F.when(F.contains(line, F.lit("`")), F.regexp_replace(line, _CODE, "<code>$1</code>")).otherwise(line)


def _line_item(line: Column) -> Column:
    def item(bare: Column) -> Column:
        space = F.substring(bare, 2, 1)
        text = F.ltrim(F.substr(bare, F.lit(2)), F.lit(JS_SPACES))
        return F.when((space != "") & F.contains(F.lit(JS_SPACES), space), F.concat(F.lit("<li>"), text, F.lit("</li>"))).otherwise(line)

    bare = F.ltrim(line, F.lit(" \t"))
    return F.when(F.startswith(bare, F.lit("-")) | F.startswith(bare, F.lit("*")), _let(bare, item)).otherwise(line)


# A run of list items; possessive, so that it is matched in a loop, whatever its length.
_ITEMS = r"((?:<li>[^\n]*</li>\n?)++)"


def _whole_rules():
    line = rf"({JS_CHAR}+){JS_LINE_END}"
    return (
        (rf"{JS_LINE_START}{_BOLD}{JS_SPACE}*{JS_LINE_END}", "**$1**\n\n"),
        (rf"{JS_LINE_START}### {line}", "<h3>$1</h3>"),
        (rf"{JS_LINE_START}##? {line}", "<h2>$1</h2>"),
        (_BOLD, "<strong>$1</strong>"),
        (_ITALIC, "<em>$1</em>"),
        (_CODE, "<code>$1</code>"),
        (rf"{JS_LINE_START}[ \t]*[-*]{JS_SPACE}+{line}", "<li>$1</li>"),
    )


# The rules of `markdown_to_html` for a whole text, but for the one that joins list items.
_LINE_RULES = _whole_rules()


def _paragraph(block: Column) -> Column:
    is_block = F.startswith(block, F.lit("<")) & block.rlike(r"^<(h[1-6]|ul|ol|li|blockquote|pre|div)")
    wrapped = F.concat(F.lit("<p>"), F.replace(block, F.lit("\n"), F.lit(" ")), F.lit("</p>"))
    return F.when(is_block, block).otherwise(wrapped)


# Parts of a page that hold no article text.
_DROPPED_PARTS = ("script", "style", "noscript", "nav", "footer", "aside", "form")
_BLOCK_TAGS = (
    "p|div|br|hr|h[1-6]|li|ul|ol|dl|dt|dd|table|thead|tbody|tr|section|header|main|article"
    "|blockquote|pre|figure|figcaption"
)


def page_text(html: Column) -> Column:
    """Body text of an HTML page: the first `<article>`, else `<body>`, else the whole page.

    Comments, scripts, styles, navigation and footers are dropped; tables are kept, with one
    line for each row.
    """
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in _DROPPED_PARTS:
        bare = F.regexp_replace(bare, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    article = F.regexp_extract(bare, r"(?is)<article\b[^>]*>(.*?)</article\s*>", 1)
    body = F.regexp_extract(bare, r"(?is)<body\b[^>]*>(.*)</body\s*>", 1)
    chosen = F.when(article != "", article).when(body != "", body).otherwise(bare)
    rules = (
        (r"[ \t\r\n]+", " "),
        (r"(?i)</t[dh]\s*>", " "),
        (rf"(?i)</?(?:{_BLOCK_TAGS})\b[^>]*>", "\n"),
        (r"<[^>]*>", ""),
    )
    plain = _replace_all(_rewrite(chosen, rules), PAGE_ENTITIES)
    return _rewrite(plain, ((r" +", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+\z", "")))


# A script that holds one of these is the main script of a page.
SCRIPT_MARKERS = ("SITE_URL", "function init()", "allArticles")


def page_style(html: Column) -> Column:
    """Content of the first style element; null if there is none."""
    found = F.regexp_extract(html, r"(?is)<style[^>]*>(.*?)</style>", 1)
    return F.when(html.rlike(r"(?is)<style[^>]*>.*?</style>"), strip(found, JS_SPACES))


def page_script(html: Column, markers: tuple[str, ...] = SCRIPT_MARKERS) -> Column:
    """Content of the first plain script element that holds a marker; null if there is none."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script>(.*?)</script>"), F.lit(1))

    def marked(script: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(script, F.lit(m)) for m in markers])

    return strip(F.try_element_at(F.filter(scripts, marked), F.lit(1)), JS_SPACES)
