"""Exports, run records and the page landing table."""

from __future__ import annotations

import datetime as dt
import secrets

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import schemas, vocab
from leadloom.functions import text as tx
from leadloom.functions.phones import NUMBER_RUN
from leadloom.operators.merge import with_link_lists
from leadloom.operators.reports import list_leads
from leadloom.session import cut_lineage

MASKED_TEXTS = ("name", "author", "what", "why", "intent_raw_excerpt", "raw_text")


def _hide_numbers(text):
    """Home numbers keep their first two digits; other international numbers keep nothing."""

    def foreign(run):
        digits = F.regexp_replace(run, r"\D", "")
        home = (F.length(digits) == 8) | digits.rlike(rf"^(?:00)?{vocab.HOME_COUNTRY_CODE}")
        return F.when(home, run).otherwise(F.lit("+XXX XXX XXX"))

    return tx.mask_phones(tx.rewrite_matches(tx.ascii_digits(text), NUMBER_RUN, foreign))


def _masked(leads: DataFrame) -> DataFrame:
    """Phones hidden wherever they stand. Texts with other digits get ASCII ones."""
    phone = _hide_numbers(F.col("phone_normalized"))
    hidden = {c: _hide_numbers(F.col(c)) for c in MASKED_TEXTS if c in leads.columns}
    hidden |= {"phone_normalized": phone, "phone_raw": phone, "links": F.transform("links", _hide_numbers)}
    return leads.withColumns(hidden)


def export_frame(leads: DataFrame, *, mask: bool = True, salt: str | None = None) -> DataFrame:
    """All columns plus a row id. Masked exports salt the id, so it cannot be traced to a phone."""
    used = (salt or secrets.token_hex(16)) if mask else ""
    with_id = leads.withColumn("id", F.sha2(F.concat(F.lit(used), F.col("phone_normalized")), 256))
    return _masked(with_id) if mask else with_id


def export_leads(
    leads: DataFrame,
    links: DataFrame,
    folder: str,
    output_format: str = "csv",
    *,
    intent: str | None = None,
    since: str | None = None,
    limit: int | None = None,
    mask: bool = True,
) -> str:
    """Write the listed leads as CSV (16 columns, header) or JSON (all columns); returns the path.

    The order of ``list_leads`` is kept across the part files. The links of the exported leads also stand one per row,
    under the same id, in ``{path}_links``.
    """
    if output_format not in ("csv", "json"):
        raise ValueError(f"unsupported export format: {output_format}")
    options = {"intent": intent, "since": since, "limit": limit}
    chosen = cut_lineage(list_leads(leads, **options))
    listed = list_leads(with_link_lists(chosen, links))
    salt = secrets.token_hex(16)
    rows = export_frame(listed, mask=mask, salt=salt)
    stamp = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%SZ")
    path = f"{folder.rstrip('/')}/leads{'_' + intent if intent else ''}_{stamp}.{output_format}"
    if output_format == "json":
        rows.write.json(path, ignoreNullFields=False)
    else:
        lists = {c: F.to_json(F.col(c)) for c in ("intent_matched_keywords", "links")}
        (
            rows.withColumns(lists)
            .select(*vocab.EXPORT_COLUMNS)
            .write.option("header", True)
            .option("escape", '"')
            .option("encoding", "UTF-8")
            .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ssXXX")
            .csv(path)
        )
    own_id = F.sha2(F.concat(F.lit(salt if mask else ""), F.col("phone_normalized")), 256)
    link = _hide_numbers(F.col("link")) if mask else F.col("link")
    links.join(chosen.select("phone_normalized"), "phone_normalized", "left_semi").select(
        own_id.alias("id"), link.alias("link"), F.col("first_at").alias("first_at")
    ).write.json(path + "_links")
    return path


def checked_runs(runs: DataFrame) -> DataFrame:
    """Run records in the declared schema; a bad mode or status stops the job that writes them."""
    shaped = schemas.evolve(runs, schemas.RUNS)

    def only(name: str, allowed: tuple[str, ...]):
        value = F.col(name)
        message = F.concat(F.lit(f"invalid {name}: "), F.coalesce(value, F.lit("null")))
        return F.when(value.isin(*allowed), value).otherwise(F.raise_error(message).cast("string"))

    own_id = F.sha2(F.to_json(F.struct(*[c for c in shaped.columns if c != "run_id"])), 256)
    return shaped.withColumns(
        {
            "source_mode": only("source_mode", vocab.SOURCE_MODES),
            "status": only("status", vocab.RUN_STATUSES),
            "error_detail": tx.truncate(F.col("error_detail"), vocab.ERROR_DETAIL_CAP),
            "run_id": F.coalesce("run_id", own_id),
        }
    )


def append_runs(runs: DataFrame, path: str) -> None:
    checked_runs(runs).write.mode("append").parquet(path)


def archive_pages(pages: DataFrame, path: str, fetched_at: str = "captured_at") -> None:
    """Raw pages by fetch date."""
    pages.withColumn("fetch_date", F.to_date(fetched_at)).write.mode("append").partitionBy("fetch_date").parquet(path)
