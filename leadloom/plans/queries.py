"""The registered queries: every operator run over the given tables.

The tables hold no local phone posts, so several queries first derive texts, markup or
keyed rows from whole tables with plain column expressions; the same derivation stands in
the SQL twin of each query (``oracles.py``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import schemas
from leadloom.functions import html as hx
from leadloom.functions import leads as ld
from leadloom.functions import phones as ph
from leadloom.functions import text as tx
from leadloom.functions import times, urls
from leadloom.operators import activity, labels, merge, posts, reports, threads, validation
from leadloom.operators.intents import IntentRule, classify_intents, normalise, rule_hits
from leadloom.operators.leads import lead_rows, sightings
from leadloom.plans import jobs
from leadloom.session import shared_path
from leadloom.sources import pages as pg
from leadloom.sources import sinks
from leadloom.sources.keywords import load_keyword_groups
from leadloom.sources.rules import load_rules
from leadloom.sources.store import Tables
from leadloom.sources.tables import BLOCKS_A_TASK, PAGES_A_TASK, read_table, spread
from leadloom.streaming import merge as streaming

# Rules that reach every branch on the invented prose of ``documents``: several languages, a
# repeated keyword, the cap of two hits, exclusions, the phone gate and ties.
PROSE_RULES = (
    IntentRule("job_offer", "en", ("thor", "reti", "blest"), 2.0, False, ("satin",)),
    IntentRule("atelier", "fr", ("eaux", "qui ", "éon", "éon"), 3.0, False, ("elleê",)),
    IntentRule("factory", "de", ("schs", "keit", "Straß"), 2.5),
    IntentRule("subcontractor", "es", ("ción", "año", "osó"), 1.5, False, ("ñas",)),
    IntentRule("fabric_supplier", "en", ("the ", "ing"), 1.0, True),
    IntentRule("factory", "fr", ("ment", "tion"), 1.0, False, ("that",)),
)
KEYWORDS = ("ÉLLE", "straß", "ación", "thing")
CUT_DAY = "1996-01-01"


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def read(spark: SparkSession, sf: str) -> DataFrame:
        # Zone-less times in the files are UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return read_table(spark, f"{sf}/{name}.parquet")

    return read


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(_table("documents")(spark, sf))


_customer, _orders, _events = _table("customer"), _table("orders"), _table("events")
_pages, _conversations, _labels = _table("pages"), _table("conversations"), _table("labels")


# ---- text -------------------------------------------------------------------------


def compact_and_digits(spark, sf):
    t = F.col("text")
    return _documents(spark, sf).select(
        "doc_id",
        F.md5(tx.compact_text(t)).alias("compact_md5"),
        F.md5(tx.digits_only(t)).alias("digits_md5"),
        F.length(tx.digits_only(t)).cast("bigint").alias("n_digits"),
    )


def folded_text(spark, sf):
    t = F.col("text")
    return _documents(spark, sf).select(
        "doc_id", F.md5(tx.fold(t)).alias("fold_md5"), F.md5(tx.casefold(t)).alias("casefold_md5")
    )


def masked_text(spark, sf):
    return _documents(spark, sf).select("doc_id", F.md5(tx.mask_phones(F.col("text"))).alias("masked_md5"))


def masked_ids(spark, sf):
    return _customer(spark, sf).select(
        "c_custkey",
        tx.mask_id(F.col("c_name")).alias("name"),
        tx.mask_id(F.col("c_custkey").cast("string")).alias("key"),
        tx.mask_id(F.concat("c_mktsegment", F.lpad(F.col("c_custkey").cast("string"), 9, "0"))).alias("long_id"),
    )


def page_links(spark, sf):
    text = F.concat("url", F.lit(". See "), "url", F.lit(") and HTTP://x.example/a؟ or "), "html")
    return _pages(spark, sf).select("page_id", F.posexplode(tx.extract_links(text)).alias("pos", "link")).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "link"
    )


def ordered_link_list(spark, sf):
    """Permalink, link and text links of a post in their order of precedence."""
    link = F.when(F.col("page_id") % 3 != 0, F.col("url"))
    permalink = F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("/p"))).otherwise(F.col("url"))
    text = F.concat(F.lit("at "), "url", F.lit("/t, "), "url", F.lit("/p."))
    return _pages(spark, sf).select("page_id", F.array_join(ld.lead_links(text, link, permalink), " ").alias("links"))


def page_text(spark, sf):
    return spread(_pages(spark, sf)).select("page_id", F.md5(hx.element_text(F.col("html"))).alias("text_md5"))


def offer_and_need(spark, sf):
    docs = _documents(spark, sf).withColumn("clean", tx.compact_text(F.col("text")))
    c = F.col("clean")
    return docs.select(
        "doc_id",
        ld.extract_what(c, F.lit("other")).alias("what"),
        ld.extract_why(c).alias("why"),
        tx.first_sentence_matching(c, r"(?iU)(?:ement|keit|ción|blest)\b").alias("chosen"),
    )


def names(spark, sf):
    """Names in texts of three shapes, and texts without one."""
    shape = F.col("c_custkey") % 4
    named = (
        F.when(shape == 0, F.concat(F.lit("Bonjour, atelier "), "c_mktsegment", F.lit(" mode tel 1")))
        .when(shape == 1, F.concat(F.lit("مرحبا، شركة: "), "c_name", F.lit(" الخياطة.")))
        .when(shape == 2, F.concat(F.lit("nom: "), "c_mktsegment", F.lit(" hotel")))
        .otherwise(F.concat(F.lit("rien a dire "), "c_mktsegment"))
    )
    return _customer(spark, sf).select("c_custkey", ld.extract_name(tx.compact_text(named)).alias("name"))


# ---- phones -----------------------------------------------------------------------


def document_phones(spark, sf):
    found = ph.only_with_phones(_documents(spark, sf)).select("doc_id", F.posexplode("phones").alias("pos", "p"))
    return found.select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("p.raw").alias("raw"), F.col("p.e164").alias("e164")
    )


def phones_by_source(spark, sf):
    found = ph.only_with_phones(_documents(spark, sf)).select("source", "doc_id", F.explode("phones.e164").alias("e164"))
    per_number = found.groupBy("source", "e164").agg(F.count("*").alias("n"))
    return per_number.groupBy("source").agg(F.sum("n").alias("n_phones"), F.count("*").alias("n_numbers"))


def _customer_texts(spark, sf) -> DataFrame:
    """One text per customer: accepted and rejected number shapes in turn."""
    key = F.lpad(F.col("c_custkey").cast("string"), 7, "0")
    a, b, c = F.substring(key, 1, 1), F.substring(key, 2, 3), F.substring(key, 5, 3)
    arabic = F.translate(F.concat(F.lit("5"), key), "0123456789", "٠١٢٣٤٥٦٧٨٩")
    shapes = (
        F.concat(F.lit("Tel +216 2"), a, F.lit(" "), b, F.lit(" "), c),
        F.concat(F.lit("Appelez le 00216 4"), a, F.lit("."), b, F.lit("."), c, F.lit(" merci")),
        F.concat(F.lit("☎ "), arabic),
        F.concat(F.lit("WhatsApp: (9"), a, F.lit(") "), b, F.lit("-"), c),
        F.concat(F.lit("2167"), key, F.lit(" puis 2167"), key, F.lit(" et 5"), a, F.lit("/"), b, F.lit("/"), c)
    )
    rejected = (
        F.concat(F.lit("Prix 5"), a, F.lit("."), b, F.lit("."), c, F.lit(" dinars")),
        F.concat(F.lit("group_id=28475122"), key),
        F.concat(F.lit("Appelez le 8"), a, F.lit(" "), b, F.lit(" "), c),
        F.concat(F.lit("Tailles 2"), a, F.lit(" 36 38 40")),
    )
    kinds = [*shapes, *rejected]
    text = kinds[-1]
    for i, shape in enumerate(kinds[:-1]):
        text = F.when(F.col("c_custkey") % len(kinds) == i, shape).otherwise(text)
    return spread(_customer(spark, sf)).select("c_custkey", "c_mktsegment", text.alias("text"))


def local_phones(spark, sf):
    found = ph.only_with_phones(_customer_texts(spark, sf)).select("c_custkey", F.posexplode("phones").alias("pos", "p"))
    return found.select(
        "c_custkey", F.col("pos").cast("bigint").alias("pos"), F.col("p.raw").alias("raw"),
        F.col("p.e164").alias("e164"), F.col("p.kind").alias("kind"), F.col("p.region").alias("region"),
    )


def phone_prefix_counts(spark, sf):
    found = ph.only_with_phones(_customer_texts(spark, sf)).select(F.explode("phones.e164").alias("phone_normalized"))
    return reports.counts_by_prefix(found)


FOREIGN = (("+33 6", 8), ("+49", 11), ("+20", 9), ("+999 ", 8), ("+33", 11), ("0044 ", 9))


def foreign_phones(spark, sf):
    """Numbers of other countries, valid by length or not, and dates in the shape of a number."""
    def digits(length: int):
        return F.lpad(F.col("c_custkey").cast("string"), length, "7")

    n = F.col("c_custkey") % (len(FOREIGN) + 1)
    text = F.concat(F.lit("Livraison le "), F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0"), F.lit(".05.2024 ok"))
    for i, (code, length) in enumerate(FOREIGN):
        text = F.when(n == i, F.concat(F.lit(f"Call {code}"), digits(length), F.lit(" now"))).otherwise(text)
    texts = spread(_customer(spark, sf)).select("c_custkey", text.alias("text"))
    found = ph.only_with_phones(texts).select("c_custkey", F.explode("phones").alias("p"))
    return found.select("c_custkey", F.col("p.raw").alias("raw"), F.col("p.e164").alias("e164"))


# ---- intents ----------------------------------------------------------------------


def _judged(spark, sf) -> DataFrame:
    return classify_intents(_documents(spark, sf), PROSE_RULES, has_phone=F.col("lang") == "en")


def intent_scores(spark, sf):
    scores = _judged(spark, sf).select("doc_id", F.explode_outer("intent_result_scores").alias("s"))
    return scores.select("doc_id", F.col("s.intent").alias("intent"), F.col("s.score").alias("score"))


def intent_scores_by_join(spark, sf):
    """The same scores through the form for large rule tables."""
    docs = _documents(spark, sf)
    judged = classify_intents(
        docs, PROSE_RULES, has_phone=F.col("lang") == "en", max_literal_keywords=0
    )
    scores = judged.select("doc_id", F.explode_outer("intent_result_scores").alias("s"))
    return scores.select("doc_id", F.col("s.intent").alias("intent"), F.col("s.score").alias("score"))


def intent_best(spark, sf):
    r = F.col("intent_result")
    return _judged(spark, sf).select("doc_id", r["intent"].alias("intent"), r["confidence"].alias("confidence"))


def intent_evidence(spark, sf):
    r = F.col("intent_result")
    return _judged(spark, sf).select(
        "doc_id",
        r["intent"].alias("intent"),
        F.array_join(r["matched_keywords"], "|").alias("matched"),
        r["raw_excerpt"].alias("excerpt"),
    )


def evidence_json(spark, sf):
    r = F.col("intent_result")
    whole = tx.intent_json(r["intent"], r["confidence"], r["matched_keywords"], F.length(r["raw_excerpt"]).cast("string"))
    return _judged(spark, sf).select("doc_id", whole.alias("evidence"))


def _texts_with_bundled_words(spark, sf) -> DataFrame:
    """Whole documents, each with two words of the bundled rules behind it."""
    words = [w for r in load_rules() for w in (*r.keywords, *r.exclude_keywords)]
    every = F.array(*[F.lit(w) for w in words])
    chosen = [F.element_at(every, (F.pmod(F.col("doc_id") * step, F.lit(len(words))) + 1).cast("int")) for step in (1, 7)]
    text = F.concat_ws(" ", F.coalesce("text", F.lit("")), *chosen)
    return _documents(spark, sf).select("doc_id", "source", text.alias("text"), (F.col("lang") == "en").alias("gate"))


def bundled_rule_rows(spark, sf):
    """Which of the bundled rules hit which document, and by how many of their words."""
    hits = rule_hits(normalise(F.col("text")), load_rules(), F.coalesce("gate", F.lit(False)))
    # An outer generator, so that no filter looks for the words a second time.
    rows = _texts_with_bundled_words(spark, sf).select("doc_id", F.posexplode_outer(hits).alias("place", "hit"))
    return rows.filter(F.col("place").isNotNull()).select(
        "doc_id", F.col("place").cast("bigint").alias("place"), F.col("hit.intent").alias("intent"),
        F.col("hit.weight").alias("weight"), F.array_join("hit.words", "|").alias("words"),
    )


def bundled_rule_scores(spark, sf):
    judged = classify_intents(_texts_with_bundled_words(spark, sf), load_rules(), has_phone=F.col("gate"))
    # An outer generator, as above; every text has scores.
    scores = judged.select("doc_id", "intent_result", F.explode_outer("intent_result_scores").alias("s"))
    return scores.select(
        "doc_id", F.col("s.intent").alias("intent"), F.col("s.score").alias("score"),
        (F.col("s.intent") == F.col("intent_result.intent")).alias("best"),
    )


def intents_by_source(spark, sf):
    r = F.col("intent_result.intent")
    return _judged(spark, sf).groupBy("source", r.alias("intent")).agg(F.count("*").alias("count"))


def documents_with_keyword(spark, sf):
    return labels.text_matches(_documents(spark, sf), KEYWORDS).select("doc_id", "matches")


def short_labels(spark, sf):
    turns = _conversations(spark, sf)
    return labels.match_labels(turns, ("élle", "STRASS"), (r"\bth\w+ing\b", r"\bder?\b"), ("ment", "und ")).select(
        "conv_id", "turn"
    )


def keyword_group_hits(spark, sf):
    """Labels by keyword group: each turn's beginning behind a word of the bundled groups, which its number picks."""
    groups = load_keyword_groups().words
    every = list(dict.fromkeys(w for words in groups.values() for w in words))
    number = ((F.col("conv_id") * 7 + F.col("turn")) % len(every) + 1).cast("int")
    word = F.element_at(F.lit(every), number)
    rows = _conversations(spark, sf).select(F.concat(F.upper(word), F.lit(" "), F.left(F.coalesce("text", F.lit("")), F.lit(20))).alias("text"))
    for name, words in groups.items():
        rows = labels.text_matches(rows, words, out=name)
    counts = rows.agg(*[F.count(F.when(F.col(name), True)).alias(name) for name in groups])
    listed = F.array(*[F.struct(F.lit(name).alias("keyword_group"), F.col(name).alias("n")) for name in groups])
    return counts.select(F.inline(listed))


# ---- leads ------------------------------------------------------------------------


def lead_sightings(spark, sf):
    """One row per customer text and phone, with everything that is said about it."""
    found = _customer_texts(spark, sf).select(
        "c_custkey",
        F.concat(F.lit("Atelier "), "c_mktsegment", F.lit(", couture. "), "text").alias("text"),
        F.lit("g1").alias("source_group_id"),
        F.concat(F.lit("https://x.example/"), F.col("c_custkey").cast("string")).alias("link"),
    )
    rules = (
        IntentRule("atelier", "fr", ("atelier", "couture"), 3.0),
        IntentRule("job_offer", "fr", ("furniture", "couture"), 4.0, False, ("machinery",)),
    )
    return lead_rows(found, rules, keep=["c_custkey"]).select(
        "c_custkey", F.col("phone_pos").cast("bigint").alias("phone_pos"), "phone_raw", "phone_normalized", "name",
        "what", "why", "intent", "intent_confidence", F.array_join("intent_matched_keywords", "|").alias("matched"),
        F.array_join("links", " ").alias("links"), "raw_text",
    )


def _order_sightings(spark, sf) -> DataFrame:
    """Every order as a sighting of its customer; some values empty or null."""
    o = _orders(spark, sf)
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").cast("string").alias("phone_normalized"),
        F.struct(F.col("o_orderdate").alias("day"), key.alias("no")).alias("seq"),
        key.cast("string").alias("phone_raw"),
        F.when(status == "F", F.concat(F.lit("n"), key.cast("string"))).when(status == "O", "").alias("name"),
        F.concat(F.lit("what "), key.cast("string")).alias("what"),
        F.when(status != "O", F.col("o_orderpriority")).otherwise("").alias("why"),
        F.col("o_orderpriority").alias("intent"),
        F.col("o_totalprice").alias("intent_confidence"),
        F.array("o_orderstatus", "o_orderpriority").alias("intent_matched_keywords"),
        status.alias("intent_raw_excerpt"),
        F.lit("g").alias("source_group_id"),
        F.when(F.col("o_orderpriority").startswith("1"), F.concat(F.lit("a"), key.cast("string"))).alias("author"),
        F.when(F.col("o_orderpriority").startswith("2"), key).alias("timestamp_unix"),
        F.lit(None).cast("string").alias("permalink"),
        F.when(status == "P", key).alias("reactions_count"),
        F.lit(None).cast("bigint").alias("comments_count"),
        F.array(F.concat(F.lit("l"), (key % 5).cast("string")), F.lit(" "), status).alias("links"),
        F.concat(F.lit("t"), (key % 3).cast("string"), F.col("o_orderpriority")).alias("raw_text"),
        F.col("o_orderdate").alias("seen_at"),
    )


def _flat_leads(folded: DataFrame) -> DataFrame:
    return folded.select(
        "phone_normalized", "phone_raw", "name", "what", "why", "intent", "intent_confidence",
        F.array_join("intent_matched_keywords", "|").alias("matched"), "intent_raw_excerpt", "first_seen",
        "last_seen", "post_count", "author", "timestamp_unix", "reactions_count",
    )


def lead_merge(spark, sf):
    return _flat_leads(merge.fold_scalars(merge.as_fold_rows(_order_sightings(spark, sf))))


def lead_merge_in_batches(spark, sf):
    """The same through a state table: the orders up to a day, then the rest on top."""
    found = merge.as_fold_rows(_order_sightings(spark, sf))
    state = merge.fold_scalars(found.filter(F.col("first_seen") < CUT_DAY))
    first = F.struct(F.lit("0001-01-01").cast("timestamp").alias("day"), F.lit(-1).cast("bigint").alias("no"))
    later = found.filter(F.col("first_seen") >= CUT_DAY)
    return _flat_leads(merge.fold_scalars(later.unionByName(state.withColumn("seq", first), True)))


def lead_merge_by_stream_batches(spark, sf):
    """The same in batches of years, as a stream would bring them: each batch folds onto the state before."""
    found = merge.as_fold_rows(_order_sightings(spark, sf))
    first = F.struct(F.lit("0001-01-01").cast("timestamp").alias("day"), F.lit(-1).cast("bigint").alias("no"))
    state = None
    year = F.year("first_seen")
    for inside in (year < 1994, year.between(1994, 1995), year.between(1996, 1997), year > 1997):
        batch = found.filter(inside)
        if state is not None:
            batch = batch.unionByName(state.withColumn("seq", first), True)
        state = merge.fold_scalars(batch)
    return _flat_leads(state)


def _numbered_sightings(rows: DataFrame, version: int) -> DataFrame:
    """The order sightings of one batch, in the order of the lead tables' own numbers."""
    seq = F.struct(
        F.lit(version).cast("bigint").alias("batch_no"), F.datediff("seq.day", F.lit("1970-01-01")).cast("bigint").alias("post_order"),
        F.lit(0).alias("is_comment"), F.col("seq.no").cast("bigint").alias("comment_order"), F.lit(0).alias("phone_pos"),
    )
    return rows.withColumn("seq", seq)


def stream_merged_leads(spark, sf):
    """The same by a bounded stream over files: a run each for the years up to 1995 and after it, into bucketed tables.

    Then the first batch comes once more, which changes nothing.
    """
    found = _order_sightings(spark, sf)
    folder = shared_path(spark, "lead-stream")
    store = Tables(spark, f"{folder}/tables", buckets=8)

    def fold(rows: DataFrame, batch: int) -> bool:
        return streaming.fold_batch(store, lambda version: _numbered_sightings(rows, version), batch, "orders")

    early = F.col("seen_at") < CUT_DAY
    for part in (found.filter(early), found.filter(~early)):
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(found.schema).parquet(f"{folder}/in").writeStream.foreachBatch(fold)
        stream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    fold(found.filter(early), 0)
    return _flat_leads(store.read("leads", schemas.LEADS))


def ingest_counters(spark, sf):
    """What the run records count of two changes of the lead tables: the orders up to a day, then the rest."""
    found = _order_sightings(spark, sf)
    store = Tables(spark, shared_path(spark, "lead-tables"), buckets=8)
    early, rows = F.col("seen_at") < CUT_DAY, []
    for part in (found.filter(early), found.filter(~early)):
        change = store.change()
        inserted, duplicates = jobs.fold_leads(change, _numbered_sightings(part, change.version))
        rows.append((change.commit(), inserted, duplicates))
    return spark.createDataFrame(rows, "run bigint, inserted bigint, duplicates bigint")


def export_rows(spark, sf):
    """What an unmasked export holds: an id for each phone, the lists in their cells."""
    found = _order_sightings(spark, sf)
    leads = merge.with_link_lists(merge.fold_scalars(merge.as_fold_rows(found)), merge.distinct_links(found))
    rows = sinks.export_frame(leads.withColumn("raw_text", F.lit("")), mask=False)
    return rows.select("id", "phone_normalized", "name", "intent", "post_count", F.array_join("links", "|").alias("links"))


def _with_home_phones(leads: DataFrame) -> DataFrame:
    """Customer keys as home numbers of eight digits."""
    return leads.withColumn("phone_normalized", F.concat(F.lit("+2162"), F.lpad("phone_normalized", 7, "0")))


def masked_export_rows(spark, sf):
    """What a masked export holds, with a fixed salt: numbers hidden wherever they stand, ids that tell no phone."""
    found = _order_sightings(spark, sf)
    leads = merge.with_link_lists(merge.fold_scalars(merge.as_fold_rows(found)), merge.distinct_links(found))
    leads = _with_home_phones(leads).withColumn("raw_text", F.concat(F.lit("Tel "), "phone_normalized", F.lit(" merci")))
    rows = sinks.export_frame(leads, mask=True, salt="fixed")
    return rows.select("id", "phone_normalized", "phone_raw", "raw_text", "intent", "post_count", F.array_join("links", "|").alias("links"))


def link_union(spark, sf):
    links = merge.distinct_links(_order_sightings(spark, sf))
    at = F.col("first_at")
    return links.select(
        "phone_normalized", "link", at["seq"]["day"].alias("first_day"), at["seq"]["no"].alias("first_order"),
        at["pos"].cast("bigint").alias("pos"),
    )


def link_lists(spark, sf):
    found = _order_sightings(spark, sf)
    listed = merge.with_link_lists(found.select("phone_normalized").distinct(), merge.distinct_links(found))
    return listed.select("phone_normalized", F.array_join("links", "|").alias("links"))


def raw_text_fold(spark, sf):
    """Texts per customer: few and repeated."""
    return merge.fold_raw_text(_order_sightings(spark, sf))


def raw_text_fold_hot(spark, sf):
    """Texts per role: two keys that hold all turns, far beyond the cap."""
    turns = _conversations(spark, sf).select(
        F.col("role").alias("phone_normalized"), F.struct("conv_id", "turn").alias("seq"), F.col("text").alias("raw_text")
    )
    folded = merge.fold_raw_text(turns, max_rows=256)
    return folded.select("phone_normalized", F.length("raw_text").cast("bigint").alias("n"), F.md5("raw_text").alias("md5"))


def merged_leads(spark, sf):
    found = _order_sightings(spark, sf)
    folded = merge.with_link_lists(merge.merge_leads(found), merge.distinct_links(found))
    return folded.select(
        "phone_normalized", "phone_raw", "intent", "post_count", F.array_join("links", "|").alias("links"), "raw_text"
    )


def upsert_counts(spark, sf):
    found = _order_sightings(spark, sf)
    state = found.filter(F.col("seen_at") < CUT_DAY).select("phone_normalized").distinct()
    return merge.upsert_counts(found.filter(F.col("seen_at") >= CUT_DAY), state)


def first_comment_wins(spark, sf):
    """First event per id; events of one type have no id and all stay."""
    rows = _events(spark, sf).select(
        F.when(F.col("event_type") != "error", F.concat("event_type", F.col("user_id").cast("string"))).alias("comment_id"),
        F.struct("ts", "event_id").alias("seq"), "event_id", "ts", "value",
    )
    return merge.first_per_id(rows, "comment_id", "seq").select("comment_id", "event_id", "ts", "value")


def first_comment_stream(spark, sf):
    """The same by a stream that is started and stopped for each quarter of the time; the last one brings the first day's rows late."""
    rows = _events(spark, sf).select(
        F.when(F.col("event_type") != "error", F.concat("event_type", F.col("user_id").cast("string"))).alias("comment_id"),
        "event_id", F.col("ts").cast("timestamp").alias("captured_at"), "value",
    )
    seconds = F.unix_timestamp("captured_at")
    first, last = rows.agg(F.min(seconds), F.max(seconds)).first()
    folder = shared_path(spark, "comment-stream")
    if first is None:
        return rows.withColumnRenamed("captured_at", "ts")
    step = (last - first) // 4 + 1
    for i in range(4):
        part = rows.filter(F.floor((seconds - first) / step) == i)
        once = merge.first_per_id(part.withColumn("seq", F.struct("captured_at", "event_id")), "comment_id", "seq").drop("seq")
        if i == 3:
            late = rows.filter((seconds < first + 86_400) & F.col("comment_id").isNotNull())
            late = merge.first_per_id(late.join(once.select("comment_id"), "comment_id", "left_anti").select(*rows.columns), "comment_id", "captured_at")
            once = once.unionByName(late)
        once.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        kept = streaming.stream_first_comments(stream, "10000 days").writeStream.format("parquet").option("path", f"{folder}/out")
        kept.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(rows.schema).parquet(f"{folder}/out")
    return found.select("comment_id", "event_id", F.col("captured_at").alias("ts"), "value")


def _post_rows(spark, sf) -> DataFrame:
    """Orders as post rows whose ids and permalinks cross within a customer."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    return _orders(spark, sf).select(
        F.when(F.col("o_orderstatus") != "P", F.concat(cust, F.lit("-"), (key % 4).cast("string"))).alias("post_fb_id"),
        F.when(~F.col("o_orderpriority").startswith("1"), F.concat(cust, F.lit("/"), (key % 3).cast("string"))).alias("permalink"),
        F.when(F.col("o_orderpriority").startswith("2"), F.col("o_orderpriority")).alias("author"),
        F.lit(None).cast("string").alias("author_fb_id"),
        F.lit(None).cast("bigint").alias("timestamp_unix"),
        F.when(F.col("o_orderstatus") == "F", key.cast("string")).otherwise("").alias("raw_text"),
        F.lit("g").alias("source_group_id"), F.lit("browser").alias("source_kind"),
        F.struct(F.col("o_orderdate").alias("day"), key.alias("no")).alias("seq"),
        F.col("o_orderdate").alias("seen_at"), key.alias("o_orderkey"), "o_custkey",
    )


def post_identity(spark, sf):
    """For each row: does it insert, and which row inserted the post it belongs to?"""
    keyed = posts.resolve_posts(_post_rows(spark, sf))
    owners = keyed.filter("was_inserted").select("post_key", F.col("o_orderkey").alias("post_order"))
    return keyed.join(owners, "post_key").select("o_orderkey", "was_inserted", "post_order")


def post_upsert(spark, sf):
    merged = posts.merge_posts(_post_rows(spark, sf))
    return merged.select("post_fb_id", "permalink", "author", "raw_text", "first_seen", "last_seen")


# ---- threads and reports ------------------------------------------------------------


def _thread_tables(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Conversations as posts (turn 0) and comments (the other turns)."""
    turns = _conversations(spark, sf)
    key = F.col("conv_id").cast("string")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 60 + F.col("turn"))
    post = turns.filter("turn = 0").select(
        key.alias("post_key"), F.concat(F.lit("fb"), key).alias("post_fb_id"),
        F.concat(F.lit("https://x.example/posts/"), key).alias("permalink"), F.col("role").alias("author"),
        F.col("text").alias("raw_text"), at.alias("first_seen"),
    )
    own = lambda n: F.concat(key, F.lit(":"), n.cast("string"))
    comments = turns.filter("turn > 0").select(
        key.alias("post_key"), own(F.col("turn")).alias("comment_key"), own(F.col("turn")).alias("comment_id"),
        F.when((F.col("turn") > 1) & (F.col("role") == "assistant"), own(F.col("turn") - 1)).alias("parent_comment_id"),
        F.col("role").alias("author"), "text",
        F.when(F.col("turn") % 4 != 3, F.lit(1_700_000_000) + F.col("conv_id") * 60 - F.col("turn")).alias("timestamp_unix"),
        at.alias("captured_at"),
    )
    return post, comments


def posts_with_comment_counts(spark, sf):
    return reports.posts_with_counts(*_thread_tables(spark, sf), limit=50).select(
        "post_key", "permalink", "author", "first_seen", "comment_count"
    )


def all_posts_with_comment_counts(spark, sf):
    return reports.all_posts_with_counts(*_thread_tables(spark, sf)).select("post_key", "comment_count")


def recent_comments(spark, sf):
    return reports.recent_comments(*_thread_tables(spark, sf), limit=100).select(
        "comment_key", "post_key", "author", "text", "captured_at", "post_fb_id", "post_author", "post_text"
    )


def thread_order(spark, sf):
    return threads.thread_positions(_thread_tables(spark, sf)[1])


def comment_parents(spark, sf):
    return threads.resolve_parents(_thread_tables(spark, sf)[1]).select("post_key", "comment_key", "parent_key")


def comments_per_post(spark, sf):
    return reports.comment_counts(_thread_tables(spark, sf)[1])


def thread_totals(spark, sf):
    post, comments = _thread_tables(spark, sf)
    counted = reports.total(post).withColumn("what", F.lit("posts"))
    return counted.unionByName(reports.total(comments).withColumn("what", F.lit("comments")))


def counts_by_intent(spark, sf):
    return reports.counts_by_intent(lead_merge(spark, sf))


def total_leads(spark, sf):
    return reports.total(lead_merge(spark, sf), "total_leads")


def recent_leads(spark, sf):
    return reports.list_leads(lead_merge(spark, sf), since=CUT_DAY).select("phone_normalized", "last_seen", "post_count")


def top_contacts(spark, sf):
    return reports.top_contacts(lead_merge(spark, sf), 20).select("phone_normalized", "last_seen", "post_count")


def top_contacts_by_count(spark, sf):
    return reports.top_by_count(lead_merge(spark, sf), 20).select("phone_normalized", "last_seen", "post_count")


def _runs(spark, sf) -> DataFrame:
    """Events as run records."""
    status = (
        F.when(F.col("event_type") == "view", "live_success").when(F.col("event_type") == "click", "cache_only")
        .when(F.col("event_type") == "error", "network_error").otherwise("blocked")
    )
    return _events(spark, sf).select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("run_id"), F.col("ts").alias("started_at"),
        F.when(F.col("user_id") % 2 == 0, "live").otherwise("cached").alias("source_mode"), status.alias("status"),
        F.col("user_id").alias("posts_fetched"),
    )


def checked_run_rows(spark, sf):
    """Run records as they are written: checked, long details cut."""
    runs = _runs(spark, sf).withColumn("error_detail", F.concat(F.repeat(F.col("source_mode"), 400), F.col("run_id")))
    return sinks.checked_runs(runs).select("run_id", "source_mode", "status", F.length("error_detail").alias("n_detail"))


def report_totals(spark, sf):
    """The five parts of the statistics bundle, one under the other; of the last runs the number of posts."""
    parts = reports.stats(_with_home_phones(lead_merge(spark, sf)), _runs(spark, sf))
    rows = parts["total_leads"].select(F.lit("leads").alias("part"), F.lit("").alias("key"), "n")
    for part, key in (("by_intent", "intent"), ("by_phone_prefix", "prefix"), ("runs_by_mode", "source_mode")):
        rows = rows.unionByName(parts[part].select(F.lit(part).alias("part"), F.col(key).alias("key"), F.col("count").alias("n")))
    for name in ("last_run", "last_success"):
        run = parts["last_runs"].select(
            F.lit(name).alias("part"), F.col(f"{name}.run_id").alias("key"), F.col(f"{name}.posts_fetched").cast("bigint").alias("n")
        )
        rows = rows.unionByName(run)
    return rows


def recent_runs(spark, sf):
    return reports.recent_runs(_runs(spark, sf), 20)


def runs_by_mode(spark, sf):
    return reports.runs_by_mode(_runs(spark, sf))


def last_runs(spark, sf):
    row = reports.last_runs(_runs(spark, sf))
    return row.select(
        F.col("last_run.run_id").alias("last_id"), F.col("last_run.status").alias("last_status"),
        F.col("last_success.run_id").alias("success_id"), F.col("last_success.started_at").alias("success_at"),
    )


def evolved_runs(spark, sf):
    """Run rows from before two columns were added, read in the declared shape."""
    return schemas.evolve(_runs(spark, sf), schemas.RUNS).select(
        "run_id", "started_at", "source_mode", "status", "posts_fetched", "posts_requested", "source_kind"
    )


# ---- pages ------------------------------------------------------------------------


def page_posts(spark, sf):
    found = pg.posts_from_pages(spread(_pages(spark, sf)))
    return found.select(
        "page_id", F.col("post_no").cast("bigint").alias("post_no"), "post_id", F.md5("text").alias("text_md5"), "link"
    )


def _paragraph_pages(spark, sf) -> DataFrame:
    """Pages without articles: each turn of a conversation as paragraphs, one of them twice."""
    t = F.col("text")
    half = F.floor(F.length(t) / 2).cast("int")
    a, b = F.left(t, half), F.right(t, F.length(t) - half)
    return _conversations(spark, sf).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("page_id"),
        F.concat(
            F.lit("<html><p>"), a, F.lit("</p><P class='x'>A &amp; B &eacute;t&#233; &#x1F600; same</P><p>"), b,
            F.lit(" <a href='/q?x=1&amp;y=2'>more</a></p><p>A &amp; B été <!-- no --> &#128512; same</p></html>"),
        ).alias("html"),
    )


def paragraph_posts(spark, sf):
    return pg.posts_from_pages(_paragraph_pages(spark, sf), limit=3).select(
        "page_id", F.col("post_no").cast("bigint").alias("post_no"), "post_id", "text", "link"
    )


def page_status(spark, sf):
    """Every page with an HTTP code and a marker text from its id."""
    n = F.col("page_id") % 7
    marker = (
        F.when(n == 1, "<p>please Log in to FACEBOOK now</p>").when(n == 2, "<p>Captcha needed</p>")
        .when(n == 3, "<title>خطأ</title>").otherwise("")
    )
    code = F.when(F.col("page_id") % 11 == 3, 429).when(F.col("page_id") % 11 == 5, 500).otherwise(200)
    # A small card before the page; a page whose elements have other names.
    other_names = F.regexp_replace("html", r"(?i)<(/?)(article|p|div)\b", "<$1x-$2")
    html = F.when(n == 4, F.concat(F.lit("<wml><card>x</card></wml>"), "html")).when(n == 5, other_names).otherwise(
        F.concat(marker, "html")
    )
    pages = spread(_pages(spark, sf)).select("page_id", html.alias("html"), code.alias("code"))
    return pg.with_page_status(pages, "code").select("page_id", "status")


def url_parts(spark, sf):
    p = urls.url_parts(F.col("url"))
    return _pages(spark, sf).select(
        "page_id", p["scheme"].alias("scheme"), p["host"].alias("host"), p["path"].alias("path"),
        p["query"].alias("query"), urls.canonical_url(F.col("url")).alias("canonical"),
    )


def post_ids(spark, sf):
    """Post addresses of seven forms, made from order keys."""
    key, n = F.lpad(F.col("o_orderkey").cast("string"), 10, "7"), F.col("o_orderkey") % 7
    root = F.lit("https://www.facebook.com/")
    url = (
        F.when(n == 0, F.concat(root, F.lit("groups/1/posts/"), key, F.lit("?x=1")))
        .when(n == 1, F.concat(root, F.lit("groups/1/permalink/"), key, F.lit("/")))
        .when(n == 2, F.concat(root, F.lit("story.php?id=5&story_fbid="), key))
        .when(n == 3, F.concat(F.lit("/photo.php?fbid="), key, F.lit("&v=2")))
        .when(n == 4, F.concat(root, F.lit("g/"), key, F.lit("/about")))
        .when(n == 5, F.concat(F.lit("/groups/1/videos/"), key, F.lit("#c")))
        .otherwise(F.concat(root, F.lit("groups/1/posts/a%20b")))
    )
    rows = spread(_orders(spark, sf)).select("o_orderkey", url.alias("url"))
    return rows.select(
        "o_orderkey", urls.post_id(F.col("url")).alias("post_id"), urls.canonical_url(F.col("url")).alias("canonical"),
        urls.is_post_url(F.col("url")).alias("is_post"),
    )


def _order_blocks(spark, sf) -> DataFrame:
    """Orders as post markup with author, time, address and counts."""
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    long_date = F.date_format("o_orderdate", "MMMM d, yyyy 'at' h:mm a")
    odd = F.col("o_orderkey") % 2 == 1
    html = F.concat(
        F.lit('<article><h3><a href="/profile.php?id='), cust, F.lit('">Customer  '), cust, F.lit("</a></h3>"),
        F.when(odd, F.concat(F.lit('<abbr title="'), iso, F.lit('">x</abbr>'))).otherwise(
            F.concat(F.lit('<abbr data-utime="'), times.to_unix(F.col("o_orderdate")).cast("string"), F.lit('">x</abbr>'))
        ),
        F.lit('<a href="https://m.facebook.com/groups/77/'), F.when(odd, "permalink/").otherwise("posts/"), key,
        F.lit('/">go</a><span aria-label="'), (F.col("o_orderkey") % 50).cast("string"),
        F.lit(' reactions">r</span><a href="#">'), (F.col("o_orderkey") % 30).cast("string"), F.lit(" comments</a></article>"),
    )
    newer = F.concat(
        F.lit('<div role="article"><h2><strong>C '), cust, F.lit("</strong></h2>"),
        F.lit('<div data-ad-rendering-role="story_message"><div>Order '), key, F.lit(" &amp; more</div><div>"),
        F.col("o_orderpriority"), F.lit('</div></div><abbr title="'), long_date,
        F.lit('">x</abbr><a href="https://www.facebook.com/groups/77/posts/'), key, F.lit('?ref=1">l</a></div>'),
    )
    return spread(_orders(spark, sf), BLOCKS_A_TASK).select(
        "o_orderkey", html.alias("html"), newer.alias("newer"), F.lit("2024-01-01").cast("timestamp").alias("captured_at")
    )


def markup_fields(spark, sf):
    html = F.col("html")
    return _order_blocks(spark, sf).select(
        "o_orderkey", hx.author(html).alias("author"), hx.permalink(html, "77").alias("permalink"),
        hx.timestamp_unix(html).alias("timestamp_unix"), hx.reactions_count(html).alias("reactions"),
        hx.comments_count(html).alias("comments"),
    )


def post_fields(spark, sf):
    blocks = _order_blocks(spark, sf).select("o_orderkey", "captured_at", F.col("newer").alias("html"))
    return pg.post_fields(blocks).select("o_orderkey", "post_fb_id", "permalink", "author", "text", "timestamp_unix")


def comment_rows(spark, sf):
    """Pages made from turns: a comment, its copy, a reply and one without a name or text."""

    def block(label: str, who, said, cid):
        return F.concat(
            F.lit(f'<div aria-label="{label} '), who, F.lit('"><a href="/user/1"><span>'), who,
            F.lit('</span></a><div data-ad-preview="message"><span>'), said,
            F.lit('</span></div><abbr title="3 hrs ago">3h</abbr><a href="/c?x=1&amp;comment_id='), cid, F.lit('">l</a></div>'),
        )

    key = F.concat("conv_id", F.lit("_"), "turn")
    html = F.concat(
        block("Comment by", F.col("role"), F.col("text"), key), block("Comment by", F.col("role"), F.lit("again"), key),
        F.lit('<div aria-label="Comment by"><div></div></div>'),
        block("Reply by", F.lit("other"), F.concat("role", F.lit(": "), "text"), F.concat(key, F.lit("r"))),
    )
    pages = spread(_conversations(spark, sf)).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("page_id"), html.alias("html"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id")).alias("captured_at"),
    )
    return pg.comments_from_pages(pages).select(
        "page_id", "comment_id", "parent_comment_id", "author", "text", "timestamp_unix", "is_reply"
    )


def _group_pages(spark, sf) -> DataFrame:
    """A page per conversation: a list of links, the first turn as a post with nested blocks, the others as comments in a list."""
    turns = _conversations(spark, sf)
    item = F.concat(
        F.lit('<li><div><div role="article" data-commentid="'), "conv_id", F.lit("c"), "turn", F.lit('"><div><a href="/user/'),
        "turn", F.lit('"><span>'), "role", F.lit('</span></a></div><div dir="auto" style="text-align: start;">'), "text",
        F.lit('</div><a aria-label="Comment permalink 2 hrs ago" href="#">t</a></div></div></li>'),
    )
    post = F.concat(
        F.lit('<div role="article"><h2><strong>'), "role", F.lit('</strong></h2><div><div data-ad-preview="message"><div><div>'),
        "text", F.lit('</div></div><div>end of post</div></div></div><a href="/groups/1/posts/9" title="15 janvier 2024 à 15:05">x</a></div>'),
    )
    lists = turns.groupBy("conv_id").agg(
        F.max(F.when(F.col("turn") == 0, post)).alias("post"),
        F.array_sort(F.collect_list(F.when(F.col("turn") > 0, F.struct("turn", item.alias("item"))))).alias("items"),
    )
    html = F.concat(
        F.lit('<html><body><ul class="menu"><li><a href="/">Home</a></li></ul><div>'), "post", F.lit("<ul>"), F.array_join(F.transform("items", lambda i: i["item"]), ""),
        F.lit('</ul></div><div>Site Admin <a href="/user/0"><span>Suggested</span></a></div></body></html>'),
    )
    return lists.select(
        F.col("conv_id").alias("page_id"), html.alias("html"),
        F.concat(F.lit("https://www.facebook.com/groups/1/posts/"), F.col("conv_id") + 10_000_000).alias("url"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id")).alias("captured_at"),
    )


def nested_page_posts(spark, sf):
    posts, _ = pg.group_page(_group_pages(spark, sf))
    return posts.select("post_ref", "post_fb_id", "author", "text", "timestamp_unix")


def page_comments(spark, sf):
    _, comments = pg.group_page(_group_pages(spark, sf))
    return comments.select("post_ref", "comment_order", "comment_id", "author", "text", "timestamp_unix")


# ---- time and activity --------------------------------------------------------------


def time_texts(spark, sf):
    """Relative and absolute time texts made from events, read back against the event time."""
    n, kind = F.pmod(F.col("user_id"), F.lit(9)) + 1, F.col("event_id") % 10
    s = n.cast("string")
    french = F.element_at(F.lit([m.split("|")[2 if i not in (4,) else 1] for i, m in enumerate(times.MONTHS)]), F.month("ts"))
    arabic = F.element_at(F.lit([m.split("|")[-1] for m in times.MONTHS]), F.month("ts"))
    # The weekday that lies 1 to 7 days back.
    weekday = F.element_at(
        F.lit([d.split("|")[2] for d in times.WEEKDAYS]), (F.pmod(F.weekday("ts") - (n % 7 + 1), F.lit(7)) + 1).cast("int")
    )
    shown = (
        F.when(kind == 0, F.concat(s, F.lit(" hrs ago"))).when(kind == 1, F.concat(F.lit("il y a "), s, F.lit(" min")))
        .when(kind == 2, F.lit("منذ ساعتين")).when(kind == 3, F.concat(F.lit("Yesterday at "), s, F.lit(":05 PM")))
        .when(kind == 4, F.date_format("ts", "MMMM d 'at' h:mm a"))
        .when(kind == 5, F.concat(F.date_format("ts", "d "), french, F.date_format("ts", " yyyy 'à' HH:mm")))
        .when(kind == 6, F.concat(F.date_format("ts", "d "), arabic, F.date_format("ts", " yyyy")))
        .when(kind == 7, F.concat(weekday, F.lit(" à "), s, F.lit(":00"))).when(kind == 8, F.date_format("ts", "dd/MM/yyyy HH:mm"))
        .otherwise(F.lit("who knows"))
    )
    parsed = times.to_unix(times.parse_timestamp(shown, F.col("ts")))
    return spread(_events(spark, sf)).select("event_id", parsed.alias("unix"))


def freshness(spark, sf):
    now = F.lit("2024-02-01").cast("timestamp")
    return _events(spark, sf).select(
        "event_id", F.round(times.age_days(F.col("ts").cast("string"), now), 6).alias("age"),
        times.is_fresh(F.col("ts").cast("string"), now, 20).alias("fresh"),
    )


def rate_window(spark, sf):
    """Events of the last six hours per user, and the wait at a cap of three."""
    return activity.trailing_activity(_events(spark, sf), "user_id", seconds=6 * 3600, cap=3).select(
        "event_id", "in_window", "seconds_to_next_slot"
    )


def busy_type_window(spark, sf):
    """The same in a minute per event type: few, very large sources."""
    return activity.trailing_activity(_events(spark, sf), "event_type", seconds=1800, cap=8).select(
        "event_id", "in_window", "seconds_to_next_slot"
    )


def dense_window(spark, sf):
    """All events as one source and a window that holds very many of them."""
    events = _events(spark, sf).withColumn("source", F.lit("all"))
    return activity.trailing_activity(events, "source", seconds=7 * 86_400, cap=8).select(
        "event_id", "in_window", "seconds_to_next_slot"
    )


def mean_gap(spark, sf):
    return activity.mean_gap(_events(spark, sf), "user_id")


# ---- validation and whole pipelines ---------------------------------------------------


def _expected(spark, sf) -> tuple[DataFrame, DataFrame]:
    """What the first customer shapes must give, some of it wrong on purpose, and what they give."""
    found = lead_sightings(spark, sf).select("c_custkey", "phone_normalized", "intent")
    key = F.lpad(F.col("c_custkey").cast("string"), 7, "0")
    n = F.col("c_custkey") % 9
    phones = (
        F.when(n == 0, F.array(F.concat(F.lit("+2162"), key))).when(n == 1, F.array(F.concat(F.lit("+2164"), key)))
        .when(n == 2, F.array(F.concat(F.lit("+2165"), key))).when(n == 3, F.array(F.concat(F.lit("+2160"), key)))
        .when(n == 4, F.array(F.concat(F.lit("+2167"), key), F.concat(F.lit("+2165"), key)))
        .otherwise(F.array().cast("array<string>"))
    )
    expected = _customer(spark, sf).select(
        "c_custkey", phones.alias("expected_phones"),
        F.lit("job_offer").alias("expected_intent"),
        F.size(phones).cast("bigint").alias("expected_leads"),
    )
    return expected, found


def validation_rows(spark, sf):
    checked = validation.validate(*_expected(spark, sf), key="c_custkey")
    return checked.select(
        "c_custkey", F.array_join("phones", "|").alias("phones"), F.array_join("intents", "|").alias("intents"), "passed"
    )


def validation_totals(spark, sf):
    return validation.validation_totals(validation.validate(*_expected(spark, sf), key="c_custkey"))


def page_leads(spark, sf):
    """The page job with the bundled rules over whole pages, each article with a number and a word of the rules."""
    words = F.array(*[F.lit(w) for r in load_rules() for w in r.keywords])
    page = F.col("page_id")
    number = F.concat(F.lit(" Tel 2"), F.lpad(F.floor(page / 2).cast("string"), 7, "0"), F.lit(" "))
    word = F.element_at(words, (F.pmod(page, F.size(words)) + 1).cast("int"))
    html = F.replace(F.col("html"), F.lit("</article>"), F.concat(number, word, F.lit("</article>")))
    pages = _table("pages")(spark, sf).select(
        "page_id", html.alias("html"), F.timestamp_seconds(F.lit(1_700_000_000) + page).alias("captured_at")
    )
    store = Tables(spark, shared_path(spark, "page-leads"), buckets=8)
    jobs.ingest_pages(store, spread(pages, PAGES_A_TASK), load_rules(), "77")
    return store.read("leads", schemas.LEADS).select(
        "phone_normalized", "phone_raw", "intent", "intent_confidence", "post_count", "first_seen", "last_seen"
    )


def thread_leads(spark, sf):
    """Posts and comments with a number each, to sightings, to merged leads: the whole way."""
    turns = spread(_conversations(spark, sf))
    number = F.concat(F.lit("2"), F.lpad((F.col("conv_id") * 2 + F.col("turn") % 2).cast("string"), 7, "0"))
    text = F.concat("text", F.lit(" Tel "), number)
    base = turns.select(
        text.alias("text"), F.lit("g").alias("source_group_id"), F.col("conv_id").alias("post_order"), "turn",
        F.col("turn").alias("comment_order"), F.col("role").alias("author"),
        F.concat(F.lit("https://x.example/posts/"), F.col("conv_id").cast("string")).alias("link"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 60 + F.col("turn")).alias("seen_at"),
    )
    post = base.filter("turn = 0").drop("turn", "comment_order", "author")
    comment = base.filter("turn > 0").drop("turn").withColumn("permalink", F.col("link"))
    folded = merge.fold_scalars(merge.as_fold_rows(sightings(post, comment, PROSE_RULES)))
    return folded.select("phone_normalized", "phone_raw", "intent", "post_count", "first_seen", "last_seen", "author", "permalink")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        compact_and_digits, folded_text, masked_text, masked_ids, page_links, ordered_link_list, page_text,
        offer_and_need, names, document_phones, phones_by_source, local_phones, foreign_phones, phone_prefix_counts, intent_scores, intent_scores_by_join,
        intent_best, intent_evidence, evidence_json, bundled_rule_rows, bundled_rule_scores, intents_by_source, documents_with_keyword, short_labels, keyword_group_hits, lead_sightings,
        lead_merge, lead_merge_in_batches, lead_merge_by_stream_batches, stream_merged_leads, ingest_counters, export_rows, masked_export_rows, link_union, link_lists, raw_text_fold, raw_text_fold_hot, merged_leads,
        upsert_counts, first_comment_wins, first_comment_stream, post_identity, post_upsert, posts_with_comment_counts,
        all_posts_with_comment_counts, recent_comments, thread_order, comment_parents, comments_per_post,
        thread_totals, report_totals, checked_run_rows, counts_by_intent, total_leads, recent_leads, top_contacts, top_contacts_by_count, recent_runs,
        runs_by_mode, last_runs, evolved_runs, page_posts, paragraph_posts, page_status, url_parts, post_ids,
        markup_fields, post_fields, comment_rows, nested_page_posts, page_comments, time_texts, freshness, rate_window, busy_type_window, dense_window, mean_gap,
        validation_rows, validation_totals, page_leads, thread_leads,
    )
}
