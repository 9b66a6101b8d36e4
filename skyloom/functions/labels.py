"""Labels, names and small derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.constants import HIGH_DUST, LOW_DUST, MIN_BANDS, OTHER_BANDS, REFERENCE_BAND, SED_GROUP, TEMPLATES


def template_name(c: Column) -> Column:
    """A template label without case and outer blanks, in the spelling of the template list; other labels as they are."""
    key = F.lower(F.trim(c))
    known = F.create_map(*[x for t in TEMPLATES for x in (F.lit(t.lower()), F.lit(t))])
    return F.coalesce(known[key], key)


def sed_group(template: Column) -> Column:
    """Morphological group of a best-fit template; ``unknown`` for others and null."""
    m = F.create_map(*[F.lit(x) for kv in SED_GROUP.items() for x in kv])
    return F.coalesce(m[template], F.lit("unknown"))


def dust_group(template: Column) -> Column:
    return F.when(template.isin(*LOW_DUST), "low_dust").when(template.isin(*HIGH_DUST), "high_dust").otherwise(template)


def bands_matched(matched: dict[str, Column]) -> Column:
    """Comma-separated bands: the reference, then the matched others in their fixed order."""
    parts = [F.lit(REFERENCE_BAND)] + [F.when(F.coalesce(matched[b], F.lit(False)), b) for b in OTHER_BANDS if b in matched]
    return F.array_join(F.array_compact(F.array(*parts)), ",")


def safe_name(c: Column) -> Column:
    """A label that can be part of a file name."""
    return F.regexp_replace(c, r"[/\\\s:+]+", "_")


def with_reliability(df: DataFrame) -> DataFrame:
    """Adds ``photoz_reliable`` (four bands or more) and ``has_uband``."""
    return df.withColumns({"photoz_reliable": F.col("n_valid_bands") >= MIN_BANDS + 1, "has_uband": F.coalesce(F.col("flux_f300") > 0, F.lit(False))})


def renamed_extraction(df: DataFrame) -> DataFrame:
    """Extraction columns under their catalog names, where those do not exist yet, with the constant columns of the other extraction path."""
    names = {"x": "xcentroid", "y": "ycentroid", "flux_auto": "source_sum", "flux_auto_err": "source_error", "a": "semimajor_sigma", "b": "semiminor_sigma", "theta": "orientation", "kron_radius": "kron_radius_pix"}
    new = {to: F.col(c) for c, to in names.items() if c in df.columns and to not in df.columns}
    if "label" not in df.columns:
        new["label"] = F.monotonically_increasing_id() + 1
    return df.withColumns(new)
