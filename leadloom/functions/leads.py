"""What a lead row says about its text: name, offer, need, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import text as tx


def extract_name(clean: Column) -> Column:
    """A likely person or company name in compacted text; null when there is none.

    The patterns are tried in order. A match that is too short or too long after
    trimming does not count and the next pattern has its turn.
    """
    shortest, longest = vocab.NAME_LENGTH

    def usable(found: Column) -> Column:
        edge_free = F.btrim(found, F.lit(vocab.NAME_EDGE_CHARS))
        name = F.trim(F.element_at(F.split(edge_free, vocab.NAME_CUT, 2), 1))
        return F.when(F.length(name).between(shortest, longest), name)

    return F.coalesce(*[tx.let(F.regexp_extract(clean, p, 1), usable) for p in vocab.NAME_PATTERNS])


def extract_what(clean: Column, intent: Column) -> Column:
    """The sentence that offers something; an empty text names the intent instead."""
    sentence = tx.first_sentence_matching(clean, vocab.OFFER)
    return F.when(sentence != "", sentence).otherwise(F.concat(F.lit(vocab.WHAT_FALLBACK), intent))


def extract_why(clean: Column) -> Column:
    """The sentence that states a need."""
    sentence = tx.first_sentence_matching(clean, vocab.NEED)
    return F.when(sentence != "", sentence).otherwise(F.lit(vocab.WHY_FALLBACK))


def lead_links(text: Column, link: Column, permalink: Column) -> Column:
    """Ordered distinct links: permalink, link, then those in the text.

    A permalink that is already the link or in the text keeps that place.
    """
    no_links = F.array().cast("array<string>")
    in_text = F.coalesce(tx.extract_links(text), no_links)
    listed = F.concat(F.when(F.coalesce(link, F.lit("")) != "", F.array(link)).otherwise(no_links), in_text)

    def add_permalink(links: Column) -> Column:
        is_new = (F.coalesce(permalink, F.lit("")) != "") & ~F.array_contains(links, F.coalesce(permalink, F.lit("")))
        return F.when(is_new, F.concat(F.array(permalink), links)).otherwise(links)

    return F.array_distinct(tx.let(listed, add_permalink))
