"""Arithmetic columns: footprint, ceilings, intervals, prices, enums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# --- fixed values ---------------------------------------------------------------------------
INPUT_WEIGHT = 0.25
WH_PER_1K_UNITS = 0.5
WH_PER_TOKEN_UPPER = 5.671 / 10_000
WH_PER_TOKEN = WH_PER_TOKEN_UPPER * 0.1
G_CO2_PER_KWH = 445.0
TREE_G_CO2 = 60_000.0
TREE_YEARS = 10
PHONE_CHARGE_WH = 19.0
G_CO2_PER_G_WOOD = 0.47 * 44 / 12
PRICE = {"input": 1.0, "cache_read": 0.1, "cache_write_5m": 1.25, "cache_write_1h": 2.0}
SOURCES = ["chatgpt", "claude", "gemini", "copilot", "grok", "perplexity", "deepseek", "openai-messages",
           "text", "html", "page", "other"]
LENGTH_BUCKETS = ((3, 9), (10, 49), (50, 199), (200, None))
DEV_SHARE = 51
# ---------------------------------------------------------------------------------------------


def compute_units(tokens_in, tokens_out, weight: float = INPUT_WEIGHT) -> Column:
    return col(tokens_in) * F.lit(weight) + col(tokens_out)


def energy_wh(units, per_1k: float = WH_PER_1K_UNITS) -> Column:
    return col(units) / F.lit(1000.0) * F.lit(per_1k)


def footprint(tokens, wh_per_token: float = WH_PER_TOKEN) -> Column:
    wh = col(tokens) * F.lit(wh_per_token)
    g = wh / 1000 * G_CO2_PER_KWH
    year = TREE_G_CO2 / TREE_YEARS
    return F.struct(
        col(tokens).alias("tokens"), wh.alias("wh"), g.alias("g_co2"), (g / TREE_G_CO2).alias("trees_10y"),
        (g / year).alias("tree_years"), (g / (year / (365.25 * 24))).alias("tree_hours"),
        (wh / PHONE_CHARGE_WH).alias("phone_charges"), (g / G_CO2_PER_G_WOOD).alias("twig_g"))


def optimal_ceiling(post, growth, reread=None) -> Column:
    """The context ceiling with the least input in a sawtooth model: P + sqrt(2 g (P + R))."""
    extra = F.lit(0.0) if reread is None else col(reread)
    return col(post) + F.sqrt(2 * col(growth) * (col(post) + extra))


def wilson(hits, n, z: float = 1.96) -> Column:
    """struct(p, low, high); nulls when n is 0."""
    n = F.when(col(n) > 0, col(n).cast("double"))
    p = col(hits) / n
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.struct(p.alias("p"), (mid - half).alias("low"), (mid + half).alias("high"))


def percent(part, whole) -> Column:
    """100 * part / whole, 0 when the whole is 0."""
    return F.coalesce(F.try_divide(F.lit(100.0) * col(part), col(whole)), F.lit(0.0))


def length_bucket(calls) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for low, high in LENGTH_BUCKETS:
        inside = col(calls) >= low if high is None else col(calls).between(low, high)
        out = out.when(inside, F.lit(f"{low}+" if high is None else f"{low}-{high}"))
    return out.otherwise(F.lit("excluded"))


def split_of(fingerprint) -> Column:
    byte = F.conv(F.substring(F.sha2(col(fingerprint).cast("string"), 256), 1, 2), 16, 10).cast("int")
    return F.when(byte < DEV_SHARE, "dev").otherwise("test")


def source_enum(source) -> Column:
    s = F.lower(F.coalesce(col(source), F.lit("")))
    out = F.when(s.isin(SOURCES), s)
    for known in ("chatgpt", "claude", "gemini", "copilot", "grok", "perplexity", "deepseek"):
        out = out.when(s.contains(known), F.lit(known))
    return out.when(s.contains("openai"), "chatgpt").when(s.contains("x.com"), "grok").otherwise("other")


def label_ok(label) -> Column:
    return F.coalesce(col(label).rlike(r"^[\p{L}\p{N}][\p{L}\p{N}+#.\-]{1,31}\z"), F.lit(False))


def epoch_day(ts) -> Column:
    return F.to_date(F.timestamp_seconds(col(ts)))


def collapse_tool(name) -> Column:
    return F.when(col(name).startswith("mcp__"), "mcp").otherwise(col(name))
