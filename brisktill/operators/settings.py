"""Store settings: a small key/value table of at most eight allowed keys."""

from pyspark.sql import functions as F

from ..functions.coerce import float_text, float_value, leading_number, or_default
from ..schemas import SETTING_DEFAULTS
from ..sources.staging import staged_counting
from .validate import check, is_valid, setting_rules


def settings_map(settings):
    """One row with all settings as a map."""
    pairs = F.collect_list(F.struct("setting_key", "setting_value"))
    return settings.agg(F.map_from_entries(F.sort_array(pairs)).alias("settings"))


def effective_settings(settings):
    """One row with a column per allowed setting; the default applies when one is missing or empty.

    `tax_rate` is a decimal percentage; 0 is a valid rate, and text that is no number counts as missing.
    """
    value = {
        key: F.max(F.when(F.col("setting_key") == key, F.col("setting_value"))).alias(key) for key in SETTING_DEFAULTS
    }
    known = settings.filter(F.col("setting_key").isin(*SETTING_DEFAULTS)).agg(*value.values())
    columns = []
    for key, default in SETTING_DEFAULTS.items():
        text = or_default(F.col(key), default)
        if key == "tax_rate":
            rate = leading_number(text).try_cast("decimal(5,2)")
            text = F.coalesce(rate, F.lit(default).cast("decimal(5,2)"))
        columns.append(text.alias(key))
    return known.select(*columns)


def upsert_settings(settings, requests):
    """Apply batches of (batch, seq, setting_key, setting_value) to (setting_key, setting_value).

    Unknown keys are ignored. One bad tax rate or e-mail address rejects its
    whole batch. The last valid value of a key wins. Returns (new settings,
    outcomes with one row per batch).
    """
    allowed = requests.withColumn("_known", F.col("setting_key").isin(*SETTING_DEFAULTS)).withColumn(
        "setting_value", F.trim(F.coalesce("setting_value", F.lit("")))
    )
    checked = check(allowed, setting_rules())
    bad = F.max(F.col("_known") & ~is_valid())
    outcomes = checked.groupBy("batch").agg(F.when(bad, "rejected").otherwise("saved").alias("status"))
    accepted = checked.filter("_known").join(
        outcomes.filter(F.col("status") == "saved").select("batch"), "batch", "left_semi"
    )
    value = F.when(
        F.col("setting_key") == "tax_rate", float_text(float_value(F.col("setting_value")))
    ).otherwise(F.col("setting_value"))
    newest = accepted.groupBy("setting_key").agg(F.max_by(value, F.struct("batch", "seq")).alias("_new"))
    merged = settings.select("setting_key", "setting_value").join(newest, "setting_key", "full_outer")
    return merged.select("setting_key", F.coalesce("_new", "setting_value").alias("setting_value")), outcomes


def store_outcomes(outcomes):
    """The outcomes of `upsert_settings`, stored, and how many batches were saved and rejected, counted by the same write."""
    return staged_counting(outcomes, {name: F.count_if(F.col("status") == name) for name in ("saved", "rejected")})
