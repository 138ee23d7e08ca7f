"""Field extraction from HTML blocks.

Blocks are cut where their own closing tag stands (``markup``), however deep they are nested; what lies in a block is
found by flat regular expressions.
"""

from __future__ import annotations

import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import markup as mk
from leadloom.functions import text as tx

_INVISIBLE = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->"
_TAG = r"(?s)<[/!?a-zA-Z][^>]*>"
_ENTITY = r"&(?:#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]*;?)"
# Looked at before the long table.
_USUAL_ENTITIES = {
    "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": "\xa0", "&#39;": "'",
}


def _none_if_empty(value: Column) -> Column:
    return tx.let(value, lambda v: F.when(v != "", v))


def without_invisible(html: Column) -> Column:
    """Scripts, styles and comments out: their text is never shown."""
    return F.regexp_replace(html, _INVISIBLE, " ")


def _from_code_point(number: Column) -> Column:
    as_bytes = F.unhex(F.lpad(F.hex(number), 8, "0"))
    return F.when(number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF), F.decode(as_bytes, "UTF-32"))


def decode_entities(text: Column) -> Column:
    """Named, decimal and hexadecimal character references to characters; unknown ones stay."""
    table = tx.map_literal({"&" + name: out for name, out in html5.items()})

    def decoded(ref: Column) -> Column:
        usual = F.lit(None).cast("string")
        for name, out in _USUAL_ENTITIES.items():
            usual = F.when(ref == name, F.lit(out)).otherwise(usual)
        digits = F.regexp_extract(ref, r"^&#([0-9]+)", 1)
        hexes = F.regexp_extract(ref, r"^&#[xX]([0-9a-fA-F]+)", 1)
        numeric = F.when(digits != "", _from_code_point(digits.try_cast("bigint"))).when(
            hexes != "", _from_code_point(F.conv(hexes, 16, 10).try_cast("bigint"))
        )
        return F.coalesce(
            usual, F.when(ref.startswith("&#"), numeric).otherwise(F.try_element_at(table, ref)), ref
        )

    return tx.rewrite_matches(text, _ENTITY, decoded)


def balanced_blocks(html: Column, tag: str, wanted: str, *, top_only: bool = False) -> Column:
    """``array<string>``: the elements ``tag`` whose opening tag matches ``wanted``, see ``markup.elements``."""

    def cut(page: Column) -> Column:
        found = mk.matching(page, mk.elements(page, tag), wanted)
        return mk.element_texts(page, mk.outermost(found) if top_only else found)

    return tx.let(mk.markup(html), cut)


def element_text(block: Column) -> Column:
    """Visible text: pieces between tags joined by single blanks."""
    return tx.collapse_spaces(decode_entities(F.regexp_replace(without_invisible(block), _TAG, " ")))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of an opening tag, in any quotes; null when absent."""
    pattern = rf"(?is)^<[^>]*?\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"

    def value(t: Column) -> Column:
        quoted = F.concat(*[F.regexp_extract(t, pattern, i) for i in (1, 2, 3)])
        return F.when(t.rlike(pattern), decode_entities(quoted))

    return tx.let(tag, value)


_ANCHOR = r"(?is)<a\s[^>]*?\bhref\s*=\s*[^>]*>"


def hrefs(block: Column) -> Column:
    """The href of every anchor that has one, in order."""
    anchors = F.regexp_extract_all(block, F.lit(_ANCHOR), F.lit(0))
    return F.filter(F.transform(anchors, lambda a: attribute(a, "href")), lambda h: h.isNotNull())


def first_link(block: Column, base: str = vocab.DEFAULT_RELATIVE_BASE) -> Column:
    """The first anchor's href; a path gets the host in front."""
    href = attribute(_none_if_empty(F.regexp_extract(block, _ANCHOR, 0)), "href")
    return tx.let(
        _none_if_empty(href), lambda h: F.when(h.startswith("/"), F.concat(F.lit(base), h)).otherwise(h)
    )


# ---- enrichment fields of a post block --------------------------------------------
# ---- fixed values: what marks author, time and counts in the markup ----

_PROFILE_ANCHOR = (
    r"(?i)<a[^>]+href=\"[^\"]*(?:profile\.php\?id=|/user/|/groups/[^/]+/user/)[^\"]*\"[^>]*>([^<]{2,80})</a>"
)
_HOVERCARD = r"(?i)data-hovercard[^\"]*\"[^\"]*\"[^>]*>([^<]{2,80})<"
_UTIME = r"data-utime=\"(\d{10,11})\""
_ABBR_TITLE = r"<abbr[^>]*title=\"([^\"]+)\""
_REACTIONS = r"(?i)(?:aria-label|title)=\"([^\"]*?reactions?[^\"]*?)\""
_COMMENTS = r"(?i)(\d+)\s*(?:comment|comments|تعليق|تعليقات)"


def author(block: Column) -> Column:
    """Text of the first profile anchor; only without one, the hovercard text."""
    profile = _none_if_empty(F.regexp_extract(block, _PROFILE_ANCHOR, 1))
    return _none_if_empty(tx.compact_text(F.coalesce(profile, F.regexp_extract(block, _HOVERCARD, 1))))


def permalink(block: Column, group_id: str) -> Column:
    """The post's own address, by three address forms in order."""
    forms = (
        rf"(?i)href=\"(https?://[^\"]*?/{re.escape(group_id)}/permalink/[^\"]+)\"",
        rf"(?i)href=\"(https?://[^\"]*?/{re.escape(group_id)}/posts/[^\"]+)\"",
        r"(?i)href=\"(https?://[^\"]*?/story\.php\?[^\"]*story_fbid=[^\"]+)\"",
    )
    return F.coalesce(*[_none_if_empty(F.regexp_extract(block, f, 1)) for f in forms])


def abbr_title(block: Column) -> Column:
    return _none_if_empty(F.regexp_extract(block, _ABBR_TITLE, 1))


def timestamp_unix(block: Column) -> Column:
    """Seconds from ``data-utime``, else from an ISO time in ``abbr[title]``."""
    exact = F.regexp_extract(block, _UTIME, 1).try_cast("bigint")
    iso = abbr_title(block)
    shaped = F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}"), iso.try_cast("timestamp"))
    return F.coalesce(exact, F.unix_timestamp(shaped))


def reactions_count(block: Column) -> Column:
    label = F.regexp_extract(block, _REACTIONS, 1)
    return F.regexp_extract(label, r"\d+", 0).try_cast("bigint")


def comments_count(block: Column) -> Column:
    return F.regexp_extract(block, _COMMENTS, 1).try_cast("bigint")


# ---- post and comment blocks of the newer markup -----------------------------------
# ---- fixed values: what marks author, message and time in it ----

_STRONG_AUTHOR = r"(?is)<h[23]\b[^>]*>(?:(?!</h[23]>).)*?<strong\b[^>]*>(.*?)</strong>"
_SPAN_AUTHOR = r"(?is)<a\b[^>]*href=\"[^\"]*(?:/groups/[^\"]*/user/|/profile\.php)[^\"]*\"[^>]*>\s*<span\b[^>]*>(.*?)</span>"
_LINK_AUTHOR = r"(?is)<span\b[^>]*>\s*<strong\b[^>]*>\s*<a\b[^>]*role=\"link\"[^>]*>(.*?)</a>"
_MESSAGE = r"(?is)\s(?:data-ad-rendering-role=\"story_message\"|data-ad-preview=\"message\"|data-ad-comet-preview=\"message\")"
_AUTO_DIV = r"(?is)<div\b[^>]*dir=\"auto\"[^>]*>(.*?)</div>"
_TIME_LINK = (
    r"(?is)<a\b[^>]*href=\"[^\"]*/(?:posts|videos|photos)/[^\"]*\"[^>]*>\s*"
    r"<span\b[^>]*data-lexical-text=\"true\"[^>]*>(.*?)</span>"
)


def _inner_text(block: Column, pattern: str) -> Column:
    return _none_if_empty(element_text(F.regexp_extract(block, pattern, 1)))


def block_author(block: Column) -> Column:
    return F.coalesce(*[_inner_text(block, p) for p in (_STRONG_AUTHOR, _SPAN_AUTHOR, _LINK_AUTHOR)])


# A short message whose child blocks hold no further ones, in a block without a "<" inside a tag: its elements are what
# the patterns match, so nothing has to be counted.
_FLAT_CHARS = 2_000
_MESSAGE_TAG = rf"<div(?=\s)[^>]*{_MESSAGE.removeprefix('(?is)')}[^>]*(?<!/)>"
_NO_DIV = r"(?:[^<]++|<(?!div(?:\s[^>]*)?>|/div\s*>))*+"
_FLAT_DIV = rf"<div(?:\s[^>]*)?(?<!/)>{_NO_DIV}</div\s*>"
_FLAT_MESSAGE = rf"(?is)^{_MESSAGE_TAG}({_NO_DIV}(?:{_FLAT_DIV}{_NO_DIV})*+)</div\s*>"


def block_message(block: Column) -> Column:
    """The message's child blocks, one per line; else its whole text; else a plain text block."""

    def joined(children: Column, container: Column) -> Column:
        texts = F.filter(F.transform(children, element_text), lambda t: t != "")
        return tx.let(texts, lambda t: F.when(F.size(t) > 0, F.array_join(t, "\n")).otherwise(element_text(container)))

    def lines(container: Column) -> Column:
        inner = F.regexp_replace(container, r"(?is)^<div\b[^>]*>|</div\s*>$", "")
        return joined(balanced_blocks(inner, "div", ".", top_only=True), container)

    def flat_lines(begun: Column) -> Column:
        # From the message's tag on; null where it isn't flat.
        inner = F.regexp_extract(begun, _FLAT_MESSAGE, 1)
        children = F.regexp_extract_all(inner, F.lit(f"(?is){_FLAT_DIV}"), F.lit(0))
        return F.when(begun.rlike(_FLAT_MESSAGE), joined(children, F.regexp_extract(begun, _FLAT_MESSAGE, 0)))

    def of_elements(b: Column) -> Column:
        return tx.let(F.get(balanced_blocks(b, "div", _MESSAGE, top_only=True), F.lit(0)), lines)

    def found(b: Column) -> Column:
        plain = (F.length(b) <= _FLAT_CHARS) & ~b.rlike("<[^>]*<")
        flat = F.when(plain, tx.let(F.regexp_extract(b, rf"(?is){_MESSAGE_TAG}.*", 0), flat_lines))
        return F.when(b.rlike(rf"(?is)<div\b[^>]*{_MESSAGE.removeprefix('(?is)')}"), F.coalesce(flat, of_elements(b)))

    message = tx.let(block, found)
    return F.coalesce(_none_if_empty(message), _inner_text(block, _AUTO_DIV), F.lit(""))


def block_time_text(block: Column) -> Column:
    return F.coalesce(abbr_title(block), _inner_text(block, _TIME_LINK))


def link_labels(block: Column) -> Column:
    """Titles and labels, longer than five characters, of links that may show a time, in order."""
    anchors = F.regexp_extract_all(block, F.lit(r"(?is)<a\b(?:[^>]*\bhref=\"[^\"]*/posts/|[^>]*\baria-label=)[^>]*>"), F.lit(0))
    labels = F.flatten(F.transform(anchors, lambda a: F.array(attribute(a, "title"), attribute(a, "aria-label"))))
    return F.filter(labels, lambda text: F.coalesce(F.length(text) > 5, F.lit(False)))


# ---- fixed values: what marks a comment, its author, text and time ----
COMMENT_LABELS = "Comment by|Commentaire de|تعليق بواسطة"
REPLY_LABELS = "Reply by|Reponse de|رد بواسطة"
_COMMENT_OPEN = rf"(?is)\saria-label=\"[^\"]*(?:{COMMENT_LABELS}|{REPLY_LABELS})[^\"]*\""
ARTICLE_ROLE = r"(?is)\srole=[\"']article[\"']"
_PERMALINK_LABEL = r"(?is)<a\b[^>]*\saria-label=\"([^\"]*Comment permalink[^\"]*)\""


def comment_blocks(html: Column) -> Column:
    """Comment elements: labelled ones, and those with the article role that lie in a list item."""

    def found(page: Column) -> Column:
        def both(blocks: Column) -> Column:
            listed = mk.inside(mk.matching(page, blocks, ARTICLE_ROLE), mk.outermost(mk.elements(page, "li")))
            return F.sort_array(F.concat(mk.matching(page, blocks, _COMMENT_OPEN), listed))

        once = lambda ss: F.filter(ss, lambda s, i: (i == 0) | (s["first"] != F.get(ss, i - 1)["first"]))
        return mk.element_texts(page, tx.let(tx.let(mk.elements(page, "div"), both), once))

    def searched(h: Column) -> Column:
        labelled = h.rlike(rf"(?is)<div\b[^>]*{_COMMENT_OPEN.removeprefix('(?is)')}")
        worth = labelled | (h.rlike(r"(?is)<li\b") & h.rlike(rf"(?is)<div\b[^>]*{ARTICLE_ROLE.removeprefix('(?is)')}"))
        return F.when(worth, tx.let(mk.markup(h), found)).otherwise(F.array().cast("array<string>"))

    return tx.let(html, searched)


def without_comment_lists(html: Column) -> Column:
    """The page without its lists that hold comments (labelled ones, or elements with the article role); other lists stay.

    A list that is never closed isn't taken for one.
    """
    holds = rf"(?is)^<div\b[^>]*(?:{ARTICLE_ROLE.removeprefix('(?is)')}|{_COMMENT_OPEN.removeprefix('(?is)')})"

    def cut(page: Column) -> Column:
        marks = F.transform(page["tokens"], lambda t: F.when(t.rlike(holds), 1).otherwise(0))

        def lists(so_far: Column) -> Column:
            # A closed list ends with its own closing tag.
            closed = lambda s: F.get(page["tokens"], s["last"] - 1).rlike(r"(?i)^</ul")
            some = lambda s: F.get(so_far, s["last"] - 1) > F.get(so_far, s["first"])
            return mk.outermost(F.filter(mk.elements(page, "ul"), lambda s: some(s) & closed(s)))

        return mk.without_spans(page, tx.let(mk.running_sum(marks), lists))

    return tx.let(html, lambda h: F.when(h.rlike(r"(?is)<ul\b"), tx.let(mk.markup(h), cut)).otherwise(h))


def comment_time_text(block: Column) -> Column:
    label = F.regexp_replace(F.regexp_extract(block, _PERMALINK_LABEL, 1), "Comment permalink", " ")
    return F.coalesce(abbr_title(block), decode_entities(_none_if_empty(tx.collapse_spaces(label))))


_COMMENTER = (
    r"(?is)<a\b[^>]*href=['\"][^'\"]*(?:/user/|/profile\.php)[^'\"]*['\"][^>]*>\s*<span\b[^>]*>(.*?)</span>",
    r"(?is)<div\b[^>]*role=\"button\"[^>]*>\s*<strong\b[^>]*>\s*<span\b[^>]*>(.*?)</span>",
    r"(?is)<a\b[^>]*aria-hidden=\"false\"[^>]*role=\"link\"[^>]*>(.*?)</a>",
)
_COMMENT_TEXT = (
    r"(?is)<div\b[^>]*data-ad-preview=\"message\"[^>]*>\s*<span\b[^>]*>(.*?)</span>",
    r"(?is)<div\b[^>]*dir=['\"]auto['\"][^>]*style=['\"]text-align: start;['\"][^>]*>(.*?)</div>",
    r"(?is)<(?:div|span)\b[^>]*dir=['\"]auto['\"][^>]*>(.*?)</(?:div|span)>",
)


def commenter(block: Column) -> Column:
    return F.coalesce(*[_inner_text(block, p) for p in _COMMENTER])


def comment_text(block: Column) -> Column:
    return F.coalesce(*[_inner_text(block, p) for p in _COMMENT_TEXT], F.lit(""))


def comment_id(block: Column) -> Column:
    """From the comment's own link, else from its attribute."""
    linked = F.regexp_extract(block, r"(?is)<a\b[^>]*href=\"[^\"]*[?&;]comment_id=([^&\"#]+)", 1)
    own = attribute(_none_if_empty(F.regexp_extract(block, r"(?s)^<[^>]*>", 0)), "data-commentid")
    return F.coalesce(_none_if_empty(linked), _none_if_empty(own))


def is_reply_block(block: Column) -> Column:
    return block.rlike(rf"(?is)^<div\b[^>]*aria-label=\"(?:{REPLY_LABELS})")


# ---- page status ------------------------------------------------------------------


def page_status(html: Column, status_code: Column, *, strict: bool = True) -> Column:
    """Why a page has no use: blocked, login_wall, or null.

    ``strict`` keeps the observable behaviour, in which the English error title never
    counts; without it, it does.
    """
    lowered = tx.casefold(html)

    def has_any(page: Column, markers: tuple[str, ...]) -> Column:
        return F.exists(F.lit([tx.casefold_str(m) for m in markers]), lambda m: F.contains(page, m))

    def judged(page: Column) -> Column:
        title = html.contains(vocab.ERROR_TITLE_AR)
        if not strict:
            title = title | page.contains(tx.casefold_str(vocab.ERROR_TITLE_EN))
        card = page.contains("wml") & page.contains("card") & (F.length(html) < vocab.SMALL_CARD_CHARS)
        return (
            F.when(F.coalesce(status_code.isin(*vocab.BLOCKED_HTTP_CODES), F.lit(False)), F.lit("blocked"))
            .when(has_any(page, vocab.BLOCK_MARKERS), F.lit("blocked"))
            .when(has_any(page, vocab.LOGIN_MARKERS), F.lit("login_wall"))
            .when(title | card, F.lit("blocked"))
        )

    return tx.let(lowered, judged)


def fetch_status(html: Column, status_code: Column, n_posts: Column, *, strict: bool = True) -> Column:
    """Page status extended by HTTP errors and pages without posts; null for a good page."""
    return F.coalesce(
        page_status(html, status_code, strict=strict),
        F.when(status_code >= 400, F.lit("network_error")),
        F.when(n_posts == 0, F.lit("empty_or_markup_changed")),
    )
