"""Post addresses: parts, ids and the canonical form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import html as hx
from leadloom.functions import text as tx

# The generic URI grammar: 2 scheme, 4 authority, 5 path, 7 query.
_URI = r"(?s)^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"


def url_parts(url: Column) -> Column:
    part = lambda i: F.regexp_extract(url, _URI, i)
    return F.struct(
        F.lower(part(2)).alias("scheme"), part(4).alias("host"), part(5).alias("path"), part(7).alias("query")
    )


def _first_query_value(query: Column, key: str) -> Column:
    value = F.try_url_decode(F.regexp_extract(query, rf"(?:^|&){key}=([^&]+)", 1))
    return F.when(tx.collapse_spaces(value) != "", value)


def post_id(url: Column) -> Column:
    """Id of a post address: after a known path word, else a known query key, else 10+ digits."""

    def from_parts(parts: Column) -> Column:
        pieces = F.split(parts["path"], "/", -1)
        by_word = []
        for word in vocab.POST_PATH_WORDS:
            at = F.array_position(pieces, F.lit(word))
            after = F.when(at > 0, F.try_element_at(pieces, (at + 1).cast("int")))
            by_word.append(F.when(after.rlike(r"^[a-zA-Z0-9._-]+$"), after))
        by_key = [_first_query_value(parts["query"], key) for key in vocab.POST_QUERY_KEYS]
        digits = F.nullif(F.regexp_extract(parts["path"], r"/(\d{10,})/?", 1), F.lit(""))
        return F.coalesce(*by_word, *by_key, digits)

    return tx.let(url_parts(url), from_parts)


def canonical_url(url: Column, base: str = vocab.DEFAULT_SITE_BASE) -> Column:
    """Scheme, host and path; without a scheme, the default host and the path."""
    return tx.let(
        url_parts(url),
        lambda p: F.concat(
            F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit("://"), p["host"])).otherwise(F.lit(base)), p["path"]
        ),
    )


def is_post_url(url: Column, domain: str = vocab.DEFAULT_SITE_DOMAIN) -> Column:
    """An address of a post on the site, or a relative one."""
    hinted = F.exists(F.lit(list(vocab.POST_LINK_HINTS)), lambda h: F.contains(url, h))
    host = url_parts(url)["host"]
    return hinted & (host.contains(domain) | (host == ""))


def post_link(block: Column, domain: str = vocab.DEFAULT_SITE_DOMAIN) -> Column:
    """The first post address in a block, as it stands there; null when there is none."""
    return F.get(F.filter(hx.hrefs(block), lambda h: is_post_url(h, domain)), F.lit(0))
