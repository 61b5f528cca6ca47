"""Functions by their SQL names, from all families; and their registration with a session where they are plain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from . import bits, domain, extra, more, numeric, text

#: SQL name -> name here, where they differ; and those that a builtin gives as it is.
OTHER_NAMES = {
    "gen_uuid_v4": "uuid_v4", "gen_uuid_v7": "uuid_v7", "gen_ulid": "ulid", "gen_nanoid": "nanoid", "gen_ksuid": "ksuid", "gen_cuid2": "cuid2", "gen_tsid": "tsid", "gen_snowflake": "snowflake",
    "st_geom_from_text": "st_geom_from_text", "row_diff_ordinal": "row_diff", "moving_avg": "moving_average",
}
BUILTIN = ("levenshtein", "soundex", "initcap", "format_number", "row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead", "nth_value", "first_value", "last_value")


def functions() -> dict[str, Callable]:
    """Every function by name."""
    out: dict[str, Callable] = {}
    for family in (bits, text, numeric, domain, more, extra):
        out |= {n: f for n, f in vars(family).items() if callable(f) and not n.startswith("_") and n not in ("Column", "vectorized", "signed", "urljoin", "urlsplit", "urlunsplit")}
    out |= {n: getattr(F, n) for n in BUILTIN}
    return out | {n: out[m] for n, m in OTHER_NAMES.items() if m in out}
