"""Expected against actual leads, row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validate(expected: DataFrame, actual: DataFrame, key: str = "id") -> DataFrame:
    """``key, phones, intents, passed``: equal sorted phones, equal lead count and, when leads
    are expected, exactly the expected intent.

    ``expected``: expected_phones, expected_intent, expected_leads (null: one per phone).
    ``actual``: one lead per row with phone_normalized and intent. A text's leads are few.
    """
    found = actual.groupBy(key).agg(
        F.array_sort(F.collect_list("phone_normalized")).alias("phones"),
        F.array_sort(F.collect_set("intent")).alias("intents"),
    )
    none = F.array().cast("array<string>")
    joined = expected.join(found, key, "left").withColumns(
        {
            "phones": F.coalesce("phones", none),
            "intents": F.coalesce("intents", none),
            "__want": F.coalesce("expected_leads", F.size("expected_phones")).cast("bigint"),
        }
    )
    passed = (F.col("phones") == F.array_sort("expected_phones")) & (F.size("phones") == F.col("__want"))
    intent_ok = (F.col("__want") <= 0) | (F.col("intents") == F.array("expected_intent"))
    return joined.select(key, "phones", "intents", (passed & F.coalesce(intent_ok, F.lit(False))).alias("passed"))


def validation_totals(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("checked"), F.count_if(~F.col("passed")).alias("failures"))
