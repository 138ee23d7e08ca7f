"""SQL twins of the registered queries, for DuckDB over the same tables.

RE2 has no look-around, so number runs are marked first and their neighbours checked after.
"""

from __future__ import annotations

from leadloom.functions.phones import ALL_COUNTRIES, foreign_pattern
from leadloom.sources.keywords import load_keyword_groups
from leadloom.sources.rules import load_rules

# ---- fixed values: the number shapes and context words of ``vocab``, in RE2 form ----
_SEP = r"[\s.\-/()]{0,2}"
_RUN = (
    rf"(\+\d(?:{_SEP}\d){{10}}(?:(?:{_SEP}\d){{2}})?|00{_SEP}\d(?:{_SEP}\d){{10}}"
    rf"|216{_SEP}\d(?:{_SEP}\d){{7}}|\(?\d(?:{_SEP}\d){{7}})"
)
_DIGITS = "'٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789'"
_PRICE = "(?i)(prix|price|dt|tnd|dinars?|دينار|السوم|الثمن|tarif|د)"
_SIZE = "(?i)(taille|tailles|size|sizes|mesure|mesures|cm|mètre|metre|pcs|pi[eè]ces|quantit[eé]|quantity|مقاس|مقاسات|قياس|كمية|قطع)"
_MARKER = r"(?i)(?:tel|tél|telephone|téléphone|phone|whatsapp|watsap|واتساب|هاتف|تلفون|اتصل|☎|📞)\s*[:：\-]?\s*$"


def _compact(text: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({text}, 'https?://\S+', ' ', 'gi'), '\s+', ' ', 'g'))"


def _casefold(text: str) -> str:
    return f"replace(lower({text}), 'ß', 'ss')"


def _fold(text: str) -> str:
    return f"replace(strip_accents(lower({text})), 'ß', 'ss')"


def _group_hits() -> str:
    groups = load_keyword_groups().words
    quoted = lambda word: "'" + word.replace("'", "''") + "'"
    every = ", ".join(quoted(w) for w in dict.fromkeys(w for words in groups.values() for w in words))
    counts = [
        f"SELECT '{name}' AS keyword_group, count(*) FILTER ({' OR '.join(f'contains(f, {_fold(quoted(w))})' for w in words)}) AS n FROM folded"
        for name, words in groups.items()
    ]
    return f"""WITH words AS (SELECT [{every}] AS w),
folded AS (SELECT {_fold("upper(w[(conv_id * 7 + turn) % len(w) + 1]) || ' ' || left(coalesce(text, ''), 20)")} AS f FROM conversations, words)
{" UNION ALL ".join(counts)}"""


def _phones(source: str, key: str) -> str:
    """CTEs ending in ``phones(key, pos, raw, e164, digits)`` over ``source(key, text)``."""
    return rf"""
src AS ({source}),
marked AS (
  SELECT {key}, text, string_split(regexp_replace(translate(text, {_DIGITS}), '{_RUN}', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS p
  FROM src),
runs AS (
  SELECT {key}, text, i, p[i] AS run, list_sum(list_transform(p[1:i-1], lambda x: length(x)))::BIGINT AS st
  FROM (SELECT *, unnest(range(2, len(p) + 1, 2)) AS i FROM marked)),
cand AS (
  SELECT {key}, i, run, substr(text, st + 1, length(run)) AS raw, regexp_replace(run, '\D', '', 'g') AS digits,
         substr(translate(text, {_DIGITS}), greatest(st - 1, 0) + (CASE WHEN st >= 2 THEN 0 ELSE 1 END), CASE WHEN st >= 2 THEN 2 ELSE st END) AS bef2,
         substr(translate(text, {_DIGITS}), st + length(run) + 1, 2) AS aft2,
         substr(text, greatest(st - 28, 0) + 1, st + length(run) + 28 - greatest(st - 28, 0)) AS around,
         substr(text, greatest(st - 24, 0) + 1, least(st, 24)) AS before24
  FROM runs),
formed AS (
  SELECT *, CASE WHEN length(digits) = 8 THEN '+216' || digits
                 WHEN length(digits) = 11 THEN '+' || digits
                 WHEN length(digits) = 13 AND digits LIKE '00%' THEN '+' || substr(digits, 3)
                 WHEN length(digits) = 13 AND run LIKE '%+%' THEN '+' || digits END AS e164
  FROM cand
  WHERE NOT regexp_matches(bef2, '[\w+]$') AND NOT regexp_matches(bef2, '\d[ .\-/]$')
    AND NOT regexp_matches(aft2, '^[ .\-/]?\d') AND NOT regexp_matches(aft2, '^\w')),
valid AS (
  SELECT * FROM formed
  WHERE length(digits) IN (8, 11, 13)
    AND (regexp_matches(e164, '^\+216[234579]\d{{7}}$') OR regexp_matches(e164, '^\+1[2-9]\d{{2}}[2-9]\d{{6}}$')
         OR regexp_matches(e164, '{foreign_pattern(ALL_COUNTRIES)}'))
    AND NOT regexp_matches(run, '^\s*(0?[1-9]|[12]\d|3[01])[./\-](0?[1-9]|1[0-2])[./\-](?:20)?\d{{2}}\s*$')
    AND NOT (len(regexp_extract_all(run, '\d+')) >= 4
             AND len(list_filter(regexp_extract_all(run, '\d+')[1:4], lambda g: length(g) <> 2)) = 0
             AND regexp_matches(around, '{_SIZE}'))
    AND (NOT regexp_matches(around, '{_PRICE}') OR regexp_matches(before24, '{_MARKER}'))),
phones AS (
  SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS pos, trim(raw) AS raw, e164
  FROM (SELECT *, row_number() OVER (PARTITION BY {key}, e164 ORDER BY i) AS rn FROM valid) WHERE rn = 1)"""


_CUSTOMER_TEXT = """SELECT c_custkey, c_mktsegment, CASE c_custkey % 9
  WHEN 0 THEN 'Tel +216 2' || a || ' ' || b || ' ' || c
  WHEN 1 THEN 'Appelez le 00216 4' || a || '.' || b || '.' || c || ' merci'
  WHEN 2 THEN '☎ ' || translate('5' || k, '0123456789', '٠١٢٣٤٥٦٧٨٩')
  WHEN 3 THEN 'WhatsApp: (9' || a || ') ' || b || '-' || c
  WHEN 4 THEN '2167' || k || ' puis 2167' || k || ' et 5' || a || '/' || b || '/' || c
  WHEN 5 THEN 'Prix 5' || a || '.' || b || '.' || c || ' dinars'
  WHEN 6 THEN 'group_id=28475122' || k
  WHEN 7 THEN 'Appelez le 8' || a || ' ' || b || ' ' || c
  ELSE 'Tailles 2' || a || ' 36 38 40' END AS text
FROM (SELECT *, k[1:1] AS a, k[2:4] AS b, k[5:7] AS c FROM (SELECT *, lpad(c_custkey::VARCHAR, 7, '0') AS k FROM customer))"""

_FOREIGN_TEXT = """SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'Call +33 6' || lpad(c_custkey::VARCHAR, 8, '7') || ' now'
  WHEN 1 THEN 'Call +49' || lpad(c_custkey::VARCHAR, 11, '7') || ' now' WHEN 2 THEN 'Call +20' || lpad(c_custkey::VARCHAR, 9, '7') || ' now'
  WHEN 3 THEN 'Call +999 ' || lpad(c_custkey::VARCHAR, 8, '7') || ' now' WHEN 4 THEN 'Call +33' || lpad(c_custkey::VARCHAR, 11, '7') || ' now'
  WHEN 5 THEN 'Call 0044 ' || lpad(c_custkey::VARCHAR, 9, '7') || ' now'
  ELSE 'Livraison le ' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') || '.05.2024 ok' END AS text FROM customer"""

_DOC_PHONES = _phones("SELECT doc_id, source, text FROM documents", "doc_id")
_LOCAL_PHONES = _phones(_CUSTOMER_TEXT, "c_custkey")

# (rule, intent, weight, needs phone, word, place in the rule, is exclusion)
_RULES = """rules(rule, intent, weight, gate, word, pos, excl) AS (VALUES
 (0,'job_offer',2.0,false,'thor',0,false),(0,'job_offer',2.0,false,'reti',1,false),(0,'job_offer',2.0,false,'blest',2,false),
 (0,'job_offer',2.0,false,'satin',0,true),
 (1,'atelier',3.0,false,'eaux',0,false),(1,'atelier',3.0,false,'qui ',1,false),(1,'atelier',3.0,false,'éon',2,false),
 (1,'atelier',3.0,false,'éon',3,false),(1,'atelier',3.0,false,'elleê',0,true),
 (2,'factory',2.5,false,'schs',0,false),(2,'factory',2.5,false,'keit',1,false),(2,'factory',2.5,false,'Straß',2,false),
 (3,'subcontractor',1.5,false,'ción',0,false),(3,'subcontractor',1.5,false,'año',1,false),
 (3,'subcontractor',1.5,false,'osó',2,false),(3,'subcontractor',1.5,false,'ñas',0,true),
 (4,'fabric_supplier',1.0,true,'the ',0,false),(4,'fabric_supplier',1.0,true,'ing',1,false),
 (5,'factory',1.0,false,'ment',0,false),(5,'factory',1.0,false,'tion',1,false),(5,'factory',1.0,false,'that',0,true)),
intents(intent, prio, ord) AS (VALUES ('atelier',1,0),('factory',2,1),('subcontractor',4,2),('fabric_supplier',3,3),('job_offer',5,4),('other',0,5))"""



def _quoted(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def _bundled_rules() -> str:
    """The bundled rules in the form of ``_RULES``."""
    rows = [
        f"({no}, '{rule.intent}', {rule.weight}, {rule.require_phone}, {_quoted(word)}, {pos}, {excl})"
        for no, rule in enumerate(load_rules())
        for excl, words in ((False, rule.keywords), (True, rule.exclude_keywords))
        for pos, word in enumerate(words)
    ]
    intents = _RULES[_RULES.index("intents(intent") :]
    return f"rules(rule, intent, weight, gate, word, pos, excl) AS (VALUES {', '.join(rows)}),\n{intents}"


def _words_of(rules_and_exclusions: bool) -> str:
    """The bundled keywords as a list, with or without the exclusions, in the order of the rules."""
    return "[" + ", ".join(
        _quoted(w) for r in load_rules() for w in (*r.keywords, *(r.exclude_keywords if rules_and_exclusions else ()))
    ) + "]"


def _judged(source: str, rules: str = _RULES) -> str:
    """CTEs over ``source(doc_id, source, text, gate)``."""
    return rf"""{rules},
norm AS (SELECT doc_id, source, gate AS phone, text, {_casefold(_compact("text"))} AS n FROM ({source})),
hits AS (SELECT d.doc_id, r.rule, r.intent, r.weight, r.word, r.pos, r.excl
  FROM norm d JOIN rules r ON contains(d.n, {_casefold("r.word")}) AND (NOT r.gate OR d.phone)),
per_rule AS (SELECT doc_id, rule, intent, weight, count(*) FILTER (NOT excl) AS n,
    list(word ORDER BY pos) FILTER (NOT excl) AS words
  FROM hits GROUP BY ALL HAVING NOT bool_or(excl) AND count(*) FILTER (NOT excl) > 0),
score AS (SELECT d.doc_id, i.intent, i.prio, coalesce(sum(p.weight * least(p.n, 2)), 0)::DOUBLE AS score
  FROM norm d CROSS JOIN intents i LEFT JOIN per_rule p ON p.doc_id = d.doc_id AND p.intent = i.intent GROUP BY ALL),
best AS (SELECT doc_id, arg_max(intent, score * 10 + prio) AS intent, max(score) AS score, sum(score) AS total FROM score GROUP BY doc_id),
judged AS (SELECT b.doc_id, d.source, CASE WHEN score > 0 THEN b.intent ELSE 'other' END AS intent,
    CASE WHEN score > 0 THEN round_even(score / total, 3) ELSE 0.0 END AS confidence,
    score > 0 AS won, d.text, d.n
  FROM best b JOIN norm d USING (doc_id)),
evidence AS (SELECT j.doc_id, flatten(list(p.words ORDER BY p.rule)) AS words
  FROM judged j JOIN per_rule p ON p.doc_id = j.doc_id AND p.intent = j.intent GROUP BY j.doc_id)"""


_JUDGED = "WITH " + _judged("SELECT doc_id, source, text, lang = 'en' AS gate FROM documents")

_ORDER_SIGHTINGS = """s AS (SELECT o_custkey::VARCHAR AS phone_normalized, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq,
  o_orderkey::VARCHAR AS phone_raw,
  CASE o_orderstatus WHEN 'F' THEN 'n' || o_orderkey WHEN 'O' THEN '' END AS name,
  'what ' || o_orderkey AS what, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority ELSE '' END AS why,
  o_orderpriority AS intent, o_totalprice AS intent_confidence, o_orderstatus || '|' || o_orderpriority AS matched,
  o_orderstatus AS intent_raw_excerpt,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'a' || o_orderkey END AS author,
  CASE WHEN o_orderpriority LIKE '2%' THEN o_orderkey END AS timestamp_unix,
  CASE WHEN o_orderstatus = 'P' THEN o_orderkey END AS reactions_count,
  ['l' || (o_orderkey % 5), ' ', o_orderstatus] AS links,
  't' || (o_orderkey % 3) || o_orderpriority AS raw_text, o_orderdate AS seen_at, o_orderkey
  FROM orders)"""
_LEADS = f"""{_ORDER_SIGHTINGS},
leads AS (SELECT phone_normalized, arg_max(phone_raw, seq) AS phone_raw,
  coalesce(arg_max(name, seq) FILTER (name <> ''), first(name ORDER BY seq)) AS name, arg_max(what, seq) AS what, coalesce(arg_max(why, seq) FILTER (why <> ''), first(why ORDER BY seq)) AS why,
  arg_max(intent, seq) AS intent, arg_max(intent_confidence, seq) AS intent_confidence, arg_max(matched, seq) AS matched,
  arg_max(intent_raw_excerpt, seq) AS intent_raw_excerpt, min(seen_at) AS first_seen, max(seen_at) AS last_seen,
  count(*) AS post_count, arg_max(author, seq) FILTER (author IS NOT NULL) AS author,
  arg_max(timestamp_unix, seq) FILTER (timestamp_unix IS NOT NULL) AS timestamp_unix,
  arg_max(reactions_count, seq) FILTER (reactions_count IS NOT NULL) AS reactions_count
  FROM s GROUP BY 1)"""
_LINKS = f"""{_ORDER_SIGHTINGS},
each AS (SELECT phone_normalized, seq, seen_at, o_orderkey, unnest(links) AS link, unnest(range(3)) AS pos FROM s),
first_link AS (SELECT phone_normalized, link, min(seq * 10 + pos) AS place,
  arg_min(seen_at, seq * 10 + pos) AS first_day, arg_min(o_orderkey, seq * 10 + pos) AS first_order,
  arg_min(pos, seq * 10 + pos) AS pos
  FROM each WHERE trim(link) <> '' GROUP BY 1, 2)"""


def _text_fold(source: str) -> str:
    """``source(k, seq, t)`` to ``folded(k, raw_text)``."""
    sep = "chr(10) || '---' || chr(10)"
    return f"""folded AS (SELECT k, list_reduce(ts, lambda acc, t: CASE WHEN contains(acc, t) THEN right(acc, 20000)
    ELSE right(acc || {sep} || t, 20000) END) AS raw_text
  FROM (SELECT k, list(t ORDER BY seq) AS ts FROM ({source}) GROUP BY k))"""


_THREADS = """post AS (SELECT conv_id::VARCHAR AS post_key, conv_id, 'fb' || conv_id AS post_fb_id, 'https://x.example/posts/' || conv_id AS permalink,
  role AS author, text AS raw_text, make_timestamp((1700000000 + conv_id * 60 + turn) * 1000000) AS first_seen
  FROM conversations WHERE turn = 0),
comment AS (SELECT conv_id::VARCHAR AS post_key, conv_id || ':' || turn AS comment_key,
  CASE WHEN turn > 1 AND role = 'assistant' THEN conv_id || ':' || (turn - 1) END AS parent_comment_id, role AS author, text,
  CASE WHEN turn % 4 <> 3 THEN 1700000000 + conv_id * 60 - turn END AS timestamp_unix,
  make_timestamp((1700000000 + conv_id * 60 + turn) * 1000000) AS captured_at
  FROM conversations WHERE turn > 0)"""

_RUNS = """runs AS (SELECT lpad(event_id::VARCHAR, 12, '0') AS run_id, ts AS started_at,
  CASE WHEN user_id % 2 = 0 THEN 'live' ELSE 'cached' END AS source_mode,
  CASE event_type WHEN 'view' THEN 'live_success' WHEN 'click' THEN 'cache_only' WHEN 'error' THEN 'network_error' ELSE 'blocked' END AS status,
  user_id AS posts_fetched FROM events)"""

# Tags, scripts, styles and comments to blanks; the few references that the pages use to characters.
def _element_text(html: str) -> str:
    bare = rf"regexp_replace({html}, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', ' ', 'g')"
    bare = f"regexp_replace({bare}, '(?s)<[/!?a-zA-Z][^>]*>', ' ', 'g')"
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&eacute;", "é"), ("&#233;", "é"),
                      ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&#x1F600;", "😀"), ("&#128512;", "😀"), ("&amp;", "&")):
        bare = f"replace({bare}, '{ref}', '{char}')"
    return rf"trim(regexp_replace({bare}, '\s+', ' ', 'g'))"


def _block_posts(source: str, pattern: str, base: str = "https://mbasic.facebook.com") -> str:
    """CTEs ending in ``posts(page_id, post_no, post_id, text, link)`` over ``source(page_id, html)``."""
    clean = r"regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', ' ', 'g')"
    return rf"""blocks AS (SELECT page_id, regexp_extract_all({clean}, '{pattern}') AS bs FROM ({source})),
block AS (SELECT page_id, unnest(bs) AS b, unnest(range(1, len(bs) + 1)) AS i FROM blocks),
texted AS (SELECT page_id, i, {_element_text("b")} AS text,
  replace(regexp_extract(b, '(?is)<a\s[^>]*?href=["'']([^"'']*)["'']', 1), '&amp;', '&') AS href FROM block),
kept AS (SELECT *, row_number() OVER (PARTITION BY page_id, text ORDER BY i) AS rn FROM texted WHERE length(text) >= 18),
posts AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS post_no, 'html-' || i AS post_id, text,
  CASE WHEN href = '' THEN NULL WHEN href LIKE '/%' THEN '{base}' || href ELSE href END AS link FROM kept WHERE rn = 1)"""


_OFFER = "(?i)(atelier|usine|factory|sous[- ]?trait|fa[çc]on|tissu|fabric|couture|confection|نخدم|نقبل|نوفر|متوفر|للبيع|نبيع|خياطة|خياط|خيط|مصنع|معمل|قماش|موداليست|modeliste|styliste|designer|couturier|needle|tricot|knit|crochet|تريكو|حياكة|تفصيل|تفصيلة|ااجا|انخيط|اخيط|نخيط|na5dem|na5demlek|n5dm|disponible|available|j''ai|3andi|عندي|موجود)"
_NEED = r"(?i)(cherche|recherche|besoin|needed?|looking for|want(?:ed)?|مطلوب|نلوج|نحب|نحتاج|يلزم|انتداب|ننتدب|نشرى|نشتري|نبغي|نلقا|فما|شكون|وين|كيفاش|بقداش|قداش|سعر|ثمن|combien|prix|price|dispo\?|available\?)"


def _sentence(pattern: str) -> str:
    """First matching sentence of ``c``, else all of it, at most 280 characters."""
    parts = r"list_filter(list_transform(string_split(regexp_replace(c, '([.!?؟؛]) +', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
    return f"substr(coalesce(list_filter({parts}, lambda x: regexp_matches(x, '{pattern}'))[1], c), 1, 280)"


_EVENT_WINDOW = """SELECT event_id, n AS in_window,
  CASE WHEN n < {cap} THEN 0.0 ELSE greatest(oldest + {us} - us, 0) / 1000000.0 END::DOUBLE AS seconds_to_next_slot
FROM (SELECT event_id, us, no - min(no) OVER w AS n, min(us) OVER w AS oldest
  FROM (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS no FROM events)
  WINDOW w AS (PARTITION BY {key} ORDER BY us RANGE BETWEEN {us} PRECEDING AND CURRENT ROW))"""

_LEAD_ROWS = rf"""WITH {_phones("SELECT c_custkey, 'Atelier ' || c_mktsegment || ', couture. ' || text AS text FROM (" + _CUSTOMER_TEXT + ")", "c_custkey")},
leads AS (SELECT p.c_custkey, pos, raw, e164, c_mktsegment AS seg, {_compact("s.text")} AS c
  FROM phones p JOIN src s USING (c_custkey) JOIN customer USING (c_custkey)),
judged AS (SELECT *, CASE WHEN seg = 'MACHINERY' THEN 6 ELSE 6 END AS atelier,
  CASE WHEN seg = 'MACHINERY' THEN 0 WHEN seg = 'FURNITURE' THEN 8 ELSE 4 END AS job FROM leads)"""

_POST_ROWS = """rows AS (SELECT o_orderkey, o_custkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq,
  CASE WHEN o_orderstatus <> 'P' THEN o_custkey || '-' || (o_orderkey % 4) END AS pid,
  CASE WHEN o_orderpriority NOT LIKE '1%' THEN o_custkey || '/' || (o_orderkey % 3) END AS link,
  CASE WHEN o_orderpriority LIKE '2%' THEN o_orderpriority END AS author,
  CASE WHEN o_orderstatus = 'F' THEN o_orderkey::VARCHAR ELSE '' END AS raw_text FROM orders),
per_customer AS (SELECT o_custkey, list({'o': o_orderkey, 'p': pid, 'l': link} ORDER BY seq) AS rs FROM rows GROUP BY 1),
-- Replay: the state is the stored posts and, per row, the order that inserted its post.
replayed AS (SELECT o_custkey, rs, list_reduce(rs, lambda st, r: CASE
    WHEN r.p IS NOT NULL AND len(list_filter(st.posts, lambda x: x.p = r.p)) > 0
      THEN {'posts': st.posts, 'owner': list_append(st.owner, list_filter(st.posts, lambda x: x.p = r.p)[1].o)}
    WHEN r.l IS NOT NULL AND len(list_filter(st.posts, lambda x: x.l = r.l)) > 0
      THEN {'posts': st.posts, 'owner': list_append(st.owner, list_filter(st.posts, lambda x: x.l = r.l)[1].o)}
    ELSE {'posts': list_append(st.posts, r), 'owner': list_append(st.owner, r.o)} END,
    {'posts': list_filter(rs, lambda x: false), 'owner': list_filter(list_transform(rs, lambda x: x.o), lambda x: false)}) AS st
  FROM (SELECT o_custkey, rs FROM per_customer)),
owned AS (SELECT unnest(list_transform(rs, lambda x: x.o)) AS o_orderkey, unnest(st.owner) AS post_order FROM replayed)"""

_PARAGRAPHS = """SELECT conv_id * 1000 + turn AS page_id, '<html><p>' || left(text, h) || '</p><P class=''x''>A &amp; B &eacute;t&#233; &#x1F600; same</P><p>'
 || substr(text, h + 1) || ' <a href=''/q?x=1&amp;y=2''>more</a></p><p>A &amp; B été <!-- no --> &#128512; same</p></html>' AS html
 FROM (SELECT *, length(text) // 2 AS h FROM conversations)"""

_EXPECTED = f"""{_LEAD_ROWS},
actual AS (SELECT c_custkey, list_sort(list(e164)) AS phones, list_sort(list(DISTINCT CASE WHEN job > atelier THEN 'job_offer' ELSE 'atelier' END)) AS intents
  FROM judged GROUP BY 1),
expected AS (SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN ['+2162' || k] WHEN 1 THEN ['+2164' || k] WHEN 2 THEN ['+2165' || k]
  WHEN 3 THEN ['+2160' || k] WHEN 4 THEN ['+2167' || k, '+2165' || k] ELSE []::VARCHAR[] END AS want
  FROM (SELECT c_custkey, lpad(c_custkey::VARCHAR, 7, '0') AS k FROM customer)),
checked AS (SELECT e.c_custkey, coalesce(phones, []) AS phones, coalesce(intents, []) AS intents,
  coalesce(phones, []) = list_sort(want) AND len(coalesce(phones, [])) = len(want)
  AND (len(want) = 0 OR coalesce(intents, []) = ['job_offer']) AS passed
  FROM expected e LEFT JOIN actual a USING (c_custkey))"""

ORACLES: dict[str, str] = {
    "compact_and_digits": rf"""SELECT doc_id, md5({_compact("text")}) AS compact_md5,
  md5(regexp_replace(translate(text, {_DIGITS}), '\D', '', 'g')) AS digits_md5,
  length(regexp_replace(translate(text, {_DIGITS}), '\D', '', 'g')) AS n_digits FROM documents""",
    "folded_text": f"""SELECT doc_id, md5({_fold("text")}) AS fold_md5, md5({_casefold("text")}) AS casefold_md5 FROM documents""",
    "masked_text": r"""SELECT doc_id, md5(list_aggregate(list_transform(p, lambda x, i: CASE WHEN i % 2 = 1 THEN x ELSE
    (CASE WHEN regexp_matches(ltrim(x), '^(\+216|00216|216)') THEN '+216 ' ELSE '' END)
    || substr(regexp_replace(x, '\D', '', 'g'), -8, 2) || ' XXX XXX' END), 'string_agg', '')) AS masked_md5
FROM (SELECT doc_id, string_split(regexp_replace(text,
  '((?:(?:\+|00)?216[\s.\-/()]*)?\d{2}[\s.\-/()]*\d{3}[\s.\-/()]*\d{3})', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS p FROM documents)""",
    "masked_ids": """SELECT c_custkey, m(c_name) AS name, m(c_custkey::VARCHAR) AS key, m(c_mktsegment || lpad(c_custkey::VARCHAR, 9, '0')) AS long_id
FROM customer""",
    "page_links": r"""SELECT page_id, pos, rtrim(link, '.,؛،)؟]') AS link FROM (SELECT page_id, unnest(ls) AS link, unnest(range(len(ls))) AS pos
FROM (SELECT page_id, regexp_extract_all(url || '. See ' || url || ') and HTTP://x.example/a؟ or ' || html, '(?i)https?://\S+') AS ls FROM pages))""",
    "ordered_link_list": """SELECT page_id, CASE WHEN page_id % 2 = 0 AND page_id % 3 = 0 THEN url || '/t ' || url || '/p'
  ELSE url || ' ' || url || '/t ' || url || '/p' END AS links FROM pages""",
    "page_text": f"""SELECT page_id, md5({_element_text("html")}) AS text_md5 FROM pages""",
    "offer_and_need": rf"""SELECT doc_id, CASE WHEN c = '' THEN 'Detected intent: other' ELSE {_sentence(_OFFER)} END AS what,
  CASE WHEN c = '' THEN 'Not explicitly stated' ELSE {_sentence(_NEED)} END AS why,
  {_sentence(r"(?i)(?:ement|keit|ción|blest)(?:[^\pL\pN_]|$)")} AS chosen
FROM (SELECT doc_id, {_compact("text")} AS c FROM documents)""",
    "names": """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment || ' mode' WHEN 1 THEN 'Customer'
  WHEN 2 THEN c_mktsegment || ' ho' END AS name FROM customer""",
    "document_phones": f"WITH {_DOC_PHONES} SELECT doc_id, pos, raw, e164 FROM phones",
    "phones_by_source": f"""WITH {_DOC_PHONES} SELECT source, count(*) AS n_phones, count(DISTINCT e164) AS n_numbers
FROM phones JOIN documents USING (doc_id) GROUP BY source""",
    "local_phones": f"""WITH {_LOCAL_PHONES} SELECT c_custkey, pos, raw, e164,
  CASE WHEN e164[5:5] IN ('2', '4', '5', '9') THEN 'mobile' WHEN e164[5:5] = '7' THEN 'landline' ELSE 'unknown' END AS kind, 'TN' AS region FROM phones""",
    "foreign_phones": f"""WITH {_phones(_FOREIGN_TEXT, "c_custkey")} SELECT c_custkey, raw, e164 FROM phones""",
    "phone_prefix_counts": f"""WITH {_LOCAL_PHONES} SELECT substr(e164, 5, 2) AS prefix, count(*) AS count FROM phones
WHERE e164 LIKE '+216%' GROUP BY 1""",
    "intent_scores": f"{_JUDGED} SELECT doc_id, intent, score FROM score",
    "intent_scores_by_join": f"{_JUDGED} SELECT doc_id, intent, score FROM score",
    "intent_best": f"{_JUDGED} SELECT doc_id, intent, confidence FROM judged",
    "intent_evidence": rf"""{_JUDGED},
found AS (SELECT j.*, words, CASE WHEN won THEN instr({_casefold("j.text")}, {_casefold("words[1]")}) - 1 END AS k_at, length(words[1]) AS kl
  FROM judged j LEFT JOIN evidence e USING (doc_id))
SELECT doc_id, intent,
  coalesce(array_to_string(list_filter(words, lambda x, i: list_position(words, x) = i), '|'), '') AS matched,
  CASE WHEN NOT won THEN substr({_compact("text")}, 1, 200) WHEN k_at < 0 THEN substr({_compact("text")}, 1, 160)
  ELSE substr({_compact("(CASE WHEN k_at > 60 THEN '…' ELSE '' END) || substr(text, greatest(k_at - 60, 0) + 1, least(k_at + kl + 60, length(text)) - greatest(k_at - 60, 0)) || (CASE WHEN k_at + kl + 60 < length(text) THEN '…' ELSE '' END)")}, 1, 200) END AS excerpt
FROM found""",
    "evidence_json": rf"""{_JUDGED},
found AS (SELECT j.*, words, CASE WHEN won THEN instr({_casefold("j.text")}, {_casefold("words[1]")}) - 1 END AS k_at, length(words[1]) AS kl
  FROM judged j LEFT JOIN evidence e USING (doc_id))
SELECT doc_id, to_json({{'intent': intent, 'confidence': confidence,
  'matched_keywords': coalesce(list_filter(words, lambda x, i: list_position(words, x) = i), []::VARCHAR[]),
  'raw_excerpt': length(CASE WHEN NOT won THEN substr({_compact("text")}, 1, 200) WHEN k_at < 0 THEN substr({_compact("text")}, 1, 160)
  ELSE substr({_compact("(CASE WHEN k_at > 60 THEN '…' ELSE '' END) || substr(text, greatest(k_at - 60, 0) + 1, least(k_at + kl + 60, length(text)) - greatest(k_at - 60, 0)) || (CASE WHEN k_at + kl + 60 < length(text) THEN '…' ELSE '' END)")}, 1, 200) END)::VARCHAR}})::VARCHAR AS evidence
FROM found""",
    "intents_by_source": f"{_JUDGED} SELECT source, intent, count(*) AS count FROM judged GROUP BY ALL",
    "documents_with_keyword": f"""SELECT doc_id, contains(f, 'elle') OR contains(f, 'strass') OR contains(f, 'acion') OR contains(f, 'thing') AS matches
FROM (SELECT doc_id, {_fold("text")} AS f FROM documents)""",
    "short_labels": rf"""SELECT conv_id, turn FROM (SELECT conv_id, turn, trim(regexp_replace({_fold("text")}, '\s+', ' ', 'g')) AS n FROM conversations)
WHERE length(n) BETWEEN 1 AND 200 AND (contains(n, 'elle') OR contains(n, 'strass') OR regexp_matches(n, '\bth\w+ing\b') OR regexp_matches(n, '\bder?\b'))
  AND NOT (contains(n, 'ment') OR contains(n, 'und '))""",
    "keyword_group_hits": _group_hits(),
    "lead_sightings": rf"""{_LEAD_ROWS}
SELECT c_custkey, pos AS phone_pos, raw AS phone_raw, e164 AS phone_normalized, seg AS name,
  'Atelier ' || seg || ', couture.' AS what, {_sentence(_NEED)} AS why,
  CASE WHEN job > atelier THEN 'job_offer' ELSE 'atelier' END AS intent, round_even(greatest(job, atelier) / (job + atelier), 3) AS intent_confidence,
  CASE WHEN job > atelier THEN 'furniture|couture' ELSE 'atelier|couture' END AS matched, 'https://x.example/' || c_custkey AS links, c AS raw_text
FROM judged""",
    "lead_merge": f"WITH {_LEADS} SELECT * FROM leads",
    "lead_merge_in_batches": f"WITH {_LEADS} SELECT * FROM leads",
    "lead_merge_by_stream_batches": f"WITH {_LEADS} SELECT * FROM leads",
    "stream_merged_leads": f"WITH {_LEADS} SELECT * FROM leads",
    "ingest_counters": """WITH early AS (SELECT o_custkey FROM orders WHERE o_orderdate < '1996-01-01'),
later AS (SELECT o_custkey FROM orders WHERE o_orderdate >= '1996-01-01'),
new AS (SELECT count(DISTINCT o_custkey) AS n FROM later ANTI JOIN early USING (o_custkey)),
old AS (SELECT count(DISTINCT o_custkey) AS n FROM early)
SELECT 0 AS run, (SELECT n FROM old) AS inserted, (SELECT count(*) FROM early) - (SELECT n FROM old) AS duplicates
UNION ALL SELECT 1, (SELECT n FROM new), (SELECT count(*) FROM later) - (SELECT n FROM new)""",
    "export_rows": f"""WITH {_LEADS}, {_LINKS.removeprefix(_ORDER_SIGHTINGS + ",")},
lists AS (SELECT phone_normalized, string_agg(link, '|' ORDER BY place) AS links FROM first_link GROUP BY 1)
SELECT sha256(phone_normalized) AS id, phone_normalized, name, intent, post_count, links FROM leads JOIN lists USING (phone_normalized)""",
    "checked_run_rows": f"""WITH {_RUNS} SELECT run_id, source_mode, status,
  least(length(source_mode) * 400 + length(run_id), 2000) AS n_detail FROM runs""",
    "report_totals": f"""WITH {_LEADS}, {_RUNS} SELECT 'leads' AS part, '' AS key, count(*) AS n FROM leads
UNION ALL SELECT 'by_intent', intent, count(*) FROM leads GROUP BY intent
UNION ALL SELECT 'by_phone_prefix', '2' || lpad(phone_normalized, 7, '0')[1:1], count(*) FROM leads GROUP BY 2
UNION ALL SELECT 'runs_by_mode', source_mode, count(*) FROM runs GROUP BY source_mode
UNION ALL SELECT 'last_run', arg_max(run_id, (started_at, run_id)), arg_max(posts_fetched, (started_at, run_id)) FROM runs
UNION ALL SELECT 'last_success', arg_max(run_id, (started_at, run_id)), arg_max(posts_fetched, (started_at, run_id)) FROM runs
  WHERE status IN ('live_success', 'live_failed_cache_used', 'cache_only')""",
    "masked_export_rows": f"""WITH {_LEADS}, {_LINKS.removeprefix(_ORDER_SIGHTINGS + ",")},
lists AS (SELECT phone_normalized, string_agg(link, '|' ORDER BY place) AS links FROM first_link GROUP BY 1),
hidden AS (SELECT *, '2' || lpad(phone_normalized, 7, '0') AS local FROM leads JOIN lists USING (phone_normalized))
SELECT sha256('fixed+216' || local) AS id, '+216 ' || local[1:2] || ' XXX XXX' AS phone_normalized, '+216 ' || local[1:2] || ' XXX XXX' AS phone_raw,
  'Tel +216 ' || local[1:2] || ' XXX XXX merci' AS raw_text, intent, post_count, links FROM hidden""",
    "nested_page_posts": r"""SELECT conv_id::VARCHAR AS post_ref, (conv_id + 10000000)::VARCHAR AS post_fb_id, role AS author,
  trim(regexp_replace(text, '\s+', ' ', 'g')) || chr(10) || 'end of post' AS text,
  epoch(TIMESTAMP '2024-01-15 15:05:00')::BIGINT AS timestamp_unix FROM conversations WHERE turn = 0""",
    "page_comments": r"""SELECT conv_id::VARCHAR AS post_ref, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS comment_order,
  conv_id || 'c' || turn AS comment_id, role AS author, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text,
  1700000000 + conv_id - 7200 AS timestamp_unix FROM conversations WHERE turn > 0""",
    "link_union": f"WITH {_LINKS} SELECT phone_normalized, link, first_day, first_order, pos FROM first_link",
    "link_lists": f"WITH {_LINKS} SELECT phone_normalized, string_agg(link, '|' ORDER BY place) AS links FROM first_link GROUP BY 1",
    "raw_text_fold": f"""WITH {_ORDER_SIGHTINGS}, {_text_fold("SELECT phone_normalized AS k, seq, raw_text AS t FROM s")}
SELECT k AS phone_normalized, raw_text FROM folded""",
    "raw_text_fold_hot": f"""WITH {_text_fold("SELECT role AS k, conv_id * 1000 + turn AS seq, text AS t FROM conversations")}
SELECT k AS phone_normalized, length(raw_text) AS n, md5(raw_text) AS md5 FROM folded""",
    "merged_leads": f"""WITH {_LINKS}, {_text_fold("SELECT phone_normalized AS k, seq, raw_text AS t FROM s")},
joined AS (SELECT phone_normalized, string_agg(link, '|' ORDER BY place) AS links FROM first_link GROUP BY 1)
SELECT phone_normalized, arg_max(phone_raw, seq) AS phone_raw, arg_max(intent, seq) AS intent, count(*) AS post_count,
  any_value(joined.links) AS links, any_value(folded.raw_text) AS raw_text
FROM s JOIN joined USING (phone_normalized) JOIN folded ON k = phone_normalized GROUP BY 1""",
    "upsert_counts": """WITH known AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < '1996-01-01'),
later AS (SELECT o_custkey FROM orders WHERE o_orderdate >= '1996-01-01'),
new AS (SELECT count(DISTINCT o_custkey) AS n FROM later ANTI JOIN known USING (o_custkey))
SELECT (SELECT n FROM new) AS inserted, (SELECT count(*) FROM later) - (SELECT n FROM new) AS duplicates""",
    "first_comment_wins": """SELECT comment_id, event_id, ts, value FROM (
  SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY ts, event_id) AS rn FROM (
    SELECT *, CASE WHEN event_type <> 'error' THEN event_type || user_id END AS comment_id FROM events))
WHERE rn = 1 OR comment_id IS NULL""",
    "first_comment_stream": """SELECT comment_id, event_id, ts, value FROM (
  SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY ts, event_id) AS rn FROM (
    SELECT *, CASE WHEN event_type <> 'error' THEN event_type || user_id END AS comment_id FROM events))
WHERE rn = 1 OR comment_id IS NULL""",
    "post_identity": f"""WITH {_POST_ROWS} SELECT o_orderkey, o_orderkey = post_order AS was_inserted, post_order FROM owned""",
    "post_upsert": f"""WITH {_POST_ROWS}
SELECT arg_min(pid, seq, 1)[1] AS post_fb_id, arg_min(link, seq, 1)[1] AS permalink, author, raw_text, first_seen, last_seen
FROM (SELECT o.post_order, first(r.pid ORDER BY seq) AS pid, first(r.link ORDER BY seq) AS link, min(seq) AS seq,
  arg_max(author, seq) FILTER (author IS NOT NULL) AS author, coalesce(arg_max(raw_text, seq) FILTER (raw_text <> ''), '') AS raw_text,
  min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen
  FROM owned o JOIN rows r USING (o_orderkey) GROUP BY 1) GROUP BY post_order, author, raw_text, first_seen, last_seen""",
    "posts_with_comment_counts": f"""WITH {_THREADS} SELECT post_key, permalink, author, first_seen,
  (SELECT count(*) FROM comment c WHERE c.post_key = p.post_key) AS comment_count FROM post p ORDER BY first_seen DESC, post_key DESC LIMIT 50""",
    "all_posts_with_comment_counts": f"""WITH {_THREADS} SELECT post_key,
  (SELECT count(*) FROM comment c WHERE c.post_key = p.post_key) AS comment_count FROM post p""",
    "recent_comments": f"""WITH {_THREADS} SELECT comment_key, c.post_key, c.author, text, captured_at, post_fb_id, p.author AS post_author, raw_text AS post_text
FROM comment c LEFT JOIN post p USING (post_key) ORDER BY captured_at DESC, comment_key DESC LIMIT 100""",
    "thread_order": f"""WITH {_THREADS} SELECT post_key, comment_key, row_number() OVER (PARTITION BY post_key
  ORDER BY parent_comment_id IS NOT NULL, coalesce(timestamp_unix, 0), comment_key) AS position FROM comment""",
    "comment_parents": f"""WITH {_THREADS} SELECT c.post_key, c.comment_key, p.comment_key AS parent_key
FROM comment c LEFT JOIN comment p ON p.post_key = c.post_key AND p.comment_key = c.parent_comment_id""",
    "comments_per_post": f"WITH {_THREADS} SELECT post_key, count(*) AS n FROM comment GROUP BY 1",
    "thread_totals": f"WITH {_THREADS} SELECT 'posts' AS what, count(*) AS n FROM post UNION ALL SELECT 'comments', count(*) FROM comment",
    "counts_by_intent": f"WITH {_LEADS} SELECT intent, count(*) AS count FROM leads GROUP BY 1",
    "total_leads": "SELECT count(DISTINCT o_custkey) AS total_leads FROM orders",
    "recent_leads": f"WITH {_LEADS} SELECT phone_normalized, last_seen, post_count FROM leads WHERE last_seen >= DATE '1996-01-01'",
    "top_contacts": f"""WITH {_LEADS} SELECT phone_normalized, last_seen, post_count FROM leads
ORDER BY last_seen DESC, post_count DESC, phone_normalized LIMIT 20""",
    "top_contacts_by_count": f"""WITH {_LEADS} SELECT phone_normalized, last_seen, post_count FROM leads
ORDER BY post_count DESC, last_seen DESC, phone_normalized LIMIT 20""",
    "recent_runs": f"WITH {_RUNS} SELECT * FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 20",
    "runs_by_mode": f"WITH {_RUNS} SELECT source_mode, count(*) AS count FROM runs GROUP BY 1",
    "last_runs": f"""WITH {_RUNS}, r AS (SELECT *, row_number() OVER (ORDER BY started_at, run_id) AS no FROM runs)
SELECT arg_max(run_id, no) AS last_id, arg_max(status, no) AS last_status,
  arg_max(run_id, no) FILTER (status IN ('live_success', 'live_failed_cache_used', 'cache_only')) AS success_id,
  arg_max(started_at, no) FILTER (status IN ('live_success', 'live_failed_cache_used', 'cache_only')) AS success_at FROM r""",
    "evolved_runs": f"WITH {_RUNS} SELECT *, NULL::BIGINT AS posts_requested, NULL::VARCHAR AS source_kind FROM runs",
    "page_posts": rf"""WITH {_block_posts("SELECT page_id, html FROM pages", r"(?is)<article\b[^>]*>.*?</article>")}
SELECT page_id, post_no, post_id, md5(text) AS text_md5, link FROM posts""",
    "paragraph_posts": rf"""WITH {_block_posts(_PARAGRAPHS, r"(?is)<p\b[^>]*>.*?</p>")} SELECT * FROM posts WHERE post_no <= 3""",
    "page_status": rf"""WITH p AS (SELECT page_id, CASE WHEN page_id % 11 = 3 THEN 429 WHEN page_id % 11 = 5 THEN 500 ELSE 200 END AS code,
  CASE page_id % 7 WHEN 4 THEN '<wml><card>x</card></wml>' || html WHEN 5 THEN regexp_replace(html, '<(/?)(article|p|div)\b', '<\1x-\2', 'gi') WHEN 1 THEN '<p>please Log in to FACEBOOK now</p>' || html
    WHEN 2 THEN '<p>Captcha needed</p>' || html WHEN 3 THEN '<title>خطأ</title>' || html ELSE html END AS html FROM pages),
{_block_posts("SELECT * FROM p", r"(?is)<article\b[^>]*>.*?</article>")}
SELECT page_id, CASE WHEN code IN (401, 403, 429) THEN 'blocked'
  WHEN regexp_matches(lower(html), 'temporarily blocked|you can''t use this feature right now|rate limit|captcha|checkpoint') THEN 'blocked'
  WHEN regexp_matches(lower(html), 'login\.php|log in to facebook|log into facebook|you must log in|تسجيل الدخول|connectez-vous') THEN 'login_wall'
  WHEN contains(html, '<title>خطأ</title>') OR (contains(lower(html), 'wml') AND contains(lower(html), 'card') AND length(html) < 5000) THEN 'blocked'
  WHEN code >= 400 THEN 'network_error'
  WHEN page_id NOT IN (SELECT page_id FROM posts) THEN 'empty_or_markup_changed' END AS status FROM p""",
    "url_parts": r"""SELECT page_id, scheme, host, path, query, scheme || '://' || host || path AS canonical FROM (
  SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host,
    regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages)""",
    "post_ids": """SELECT o_orderkey, CASE WHEN n = 6 THEN NULL ELSE k END AS post_id,
  CASE n WHEN 0 THEN r || 'groups/1/posts/' || k WHEN 1 THEN r || 'groups/1/permalink/' || k || '/' WHEN 2 THEN r || 'story.php'
    WHEN 3 THEN r || 'photo.php' WHEN 4 THEN r || 'g/' || k || '/about' WHEN 5 THEN r || 'groups/1/videos/' || k ELSE r || 'groups/1/posts/a%20b' END AS canonical,
  n NOT IN (3, 4) AS is_post
FROM (SELECT o_orderkey, o_orderkey % 7 AS n, lpad(o_orderkey::VARCHAR, 10, '7') AS k, 'https://www.facebook.com/' AS r FROM orders)""",
    "markup_fields": """SELECT o_orderkey, 'Customer ' || o_custkey AS author,
  'https://m.facebook.com/groups/77/' || (CASE WHEN o_orderkey % 2 = 1 THEN 'permalink/' ELSE 'posts/' END) || o_orderkey || '/' AS permalink,
  CASE WHEN o_orderkey % 2 = 1 OR epoch(o_orderdate) >= 1000000000 THEN epoch(o_orderdate)::BIGINT END AS timestamp_unix, o_orderkey % 50 AS reactions, o_orderkey % 30 AS comments FROM orders""",
    "post_fields": """SELECT o_orderkey, o_orderkey::VARCHAR AS post_fb_id, 'https://www.facebook.com/groups/77/posts/' || o_orderkey AS permalink,
  'C ' || o_custkey AS author, 'Order ' || o_orderkey || ' & more' || chr(10) || o_orderpriority AS text,
  epoch(date_trunc('minute', o_orderdate))::BIGINT AS timestamp_unix FROM orders""",
    "comment_rows": r"""SELECT conv_id * 1000 + turn AS page_id, conv_id || '_' || turn AS comment_id, NULL::VARCHAR AS parent_comment_id, role AS author,
  trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, 1700000000 + conv_id - 3 * 3600 AS timestamp_unix, false AS is_reply FROM conversations
UNION ALL SELECT conv_id * 1000 + turn, conv_id || '_' || turn || 'r', conv_id || '_' || turn, 'other', trim(regexp_replace(role || ': ' || text, '\s+', ' ', 'g')), 1700000000 + conv_id - 3 * 3600, true FROM conversations""",
    "time_texts": """SELECT event_id, CASE event_id % 10 WHEN 0 THEN epoch(ts - to_hours(n))::BIGINT - x WHEN 1 THEN epoch(ts - to_minutes(n))::BIGINT - x
  WHEN 2 THEN epoch(ts - to_hours(2))::BIGINT - x WHEN 3 THEN epoch(date_trunc('day', ts))::BIGINT - 86400 + (n % 12 + 12) * 3600 + 300
  WHEN 4 THEN epoch(date_trunc('minute', ts))::BIGINT WHEN 5 THEN epoch(date_trunc('minute', ts))::BIGINT
  WHEN 6 THEN epoch(date_trunc('day', ts))::BIGINT WHEN 7 THEN epoch(date_trunc('day', ts))::BIGINT - (n % 7 + 1) * 86400 + n * 3600
  WHEN 8 THEN epoch(date_trunc('minute', ts))::BIGINT END AS unix
FROM (SELECT *, user_id % 9 + 1 AS n, CASE WHEN epoch(ts)::BIGINT > epoch(ts) THEN 1 ELSE 0 END AS x FROM events)""",
    "freshness": """SELECT event_id, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000.0, 6) AS age,
  epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts) <= 20 * 86400000000 AS fresh FROM events""",
    "rate_window": _EVENT_WINDOW.format(key="user_id", us=6 * 3600 * 1_000_000, cap=3),
    "busy_type_window": _EVENT_WINDOW.format(key="event_type", us=1800 * 1_000_000, cap=8),
    "dense_window": _EVENT_WINDOW.format(key="(SELECT 1)", us=7 * 86_400 * 1_000_000, cap=8),
    "mean_gap": """SELECT user_id, count(*) AS n, sum(gap)::DOUBLE / count(gap) / 1000000.0 AS mean_gap_seconds FROM (
  SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) GROUP BY 1""",
    "validation_rows": f"""{_EXPECTED} SELECT c_custkey, array_to_string(phones, '|') AS phones, array_to_string(intents, '|') AS intents, passed FROM checked""",
    "validation_totals": f"""{_EXPECTED} SELECT count(*) AS checked, count(*) FILTER (NOT passed) AS failures FROM checked""",
}

_TURN_TEXT = """SELECT conv_id * 1000 + turn AS doc_id, '' AS source, true AS gate,
  text || ' Tel 2' || lpad((conv_id * 2 + turn % 2)::VARCHAR, 7, '0') AS text FROM conversations"""
ORACLES["thread_leads"] = f"""WITH {_phones(_TURN_TEXT, "doc_id")}, {_judged(_TURN_TEXT)},
seen AS (SELECT p.*, j.intent, c.conv_id, c.turn, c.role, row_number() OVER (ORDER BY c.conv_id, c.turn, p.pos) AS seq,
  make_timestamp((1700000000 + c.conv_id * 60 + c.turn) * 1000000) AS at_time
  FROM phones p JOIN judged j USING (doc_id) JOIN conversations c ON c.conv_id * 1000 + c.turn = p.doc_id)
SELECT e164 AS phone_normalized, arg_max(raw, seq) AS phone_raw, arg_max(intent, seq) AS intent, count(*) AS post_count,
  min(at_time) AS first_seen, max(at_time) AS last_seen, arg_max(role, seq) FILTER (turn > 0) AS author,
  arg_max('https://x.example/posts/' || conv_id, seq) FILTER (turn > 0) AS permalink
FROM seen GROUP BY 1"""

_BUNDLED = f"""WITH {_judged(f"""SELECT doc_id, source, lang = 'en' AS gate,
  coalesce(text, '') || ' ' || w[doc_id % len(w) + 1] || ' ' || w[doc_id * 7 % len(w) + 1] AS text
  FROM documents, (SELECT {_words_of(True)} AS w)""", _bundled_rules())}"""
ORACLES["bundled_rule_rows"] = f"""{_BUNDLED} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rule) - 1 AS place, intent,
  weight::DOUBLE AS weight, array_to_string(words, '|') AS words FROM per_rule"""
ORACLES["bundled_rule_scores"] = f"""{_BUNDLED} SELECT s.doc_id, s.intent, s.score, s.intent = j.intent AS best
FROM score s JOIN judged j USING (doc_id)"""

_LEAD_PAGES = f"""SELECT page_id, replace(html, '</article>', ' Tel 2' || lpad((page_id // 2)::VARCHAR, 7, '0') || ' '
  || w[page_id % len(w) + 1] || '</article>') AS html FROM pages, (SELECT {_words_of(False)} AS w)"""
_PAGE_TEXT = "SELECT page_id * 1000 + post_no AS doc_id, '' AS source, true AS gate, text FROM posts"
ORACLES["page_leads"] = rf"""WITH {_block_posts(_LEAD_PAGES, r"(?is)<article\b[^>]*>.*?</article>")},
{_phones(_PAGE_TEXT, "doc_id")}, {_judged(_PAGE_TEXT, _bundled_rules())},
seen AS (SELECT p.*, j.intent, j.confidence, make_timestamp((1700000000 + p.doc_id // 1000) * 1000000) AS at_time,
  row_number() OVER (ORDER BY p.doc_id, p.pos) AS seq FROM phones p JOIN judged j USING (doc_id))
SELECT e164 AS phone_normalized, arg_max(raw, seq) AS phone_raw, arg_max(intent, seq) AS intent,
  arg_max(confidence, seq) AS intent_confidence, count(*) AS post_count, min(at_time) AS first_seen, max(at_time) AS last_seen
FROM seen GROUP BY 1"""

_MASK = "(CASE WHEN length({v}) <= 8 THEN repeat('*', length({v})) ELSE left({v}, 4) || repeat('*', length({v}) - 8) || right({v}, 4) END)"
ORACLES["masked_ids"] = "SELECT c_custkey, {} AS name, {} AS key, {} AS long_id FROM customer".format(
    *[_MASK.format(v=v) for v in ("c_name", "c_custkey::VARCHAR", "(c_mktsegment || lpad(c_custkey::VARCHAR, 9, '0'))")]
)
