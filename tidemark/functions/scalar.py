"""Scalar functions, as column expressions."""

from __future__ import annotations

import unicodedata
from datetime import date

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Milliseconds from the epoch to the first post id's clock (fixed value).
POST_EPOCH_MS = 1288834974657
#: Market types of game lines, period suffixes, and name suffixes that don't matter (fixed values).
GAME_LINES = ("MONEY", "SPREAD", "TOTAL", "TEAM_TOTAL")
PERIOD = r"_(?:1H|2H|1Q|2Q|3Q|4Q)$"
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?Z$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def post_time(post_id: Column) -> Column:
    """Creation time held in a post id; ids that are not positive are an error."""
    return F.when(post_id > 0, F.timestamp_millis(F.shiftright(post_id.cast("long"), 22) + F.lit(POST_EPOCH_MS))).when(post_id.isNotNull(), F.raise_error(F.concat(F.lit("not a post id: "), post_id.cast("string"))).cast("timestamp"))


def uuid7_time(uid: Column) -> Column:
    """Creation time held in the first 48 bits of a version 7 UUID."""
    return F.timestamp_millis(F.conv(F.substring(F.replace(uid, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("long"))


def season_week(kickoff: Column, start: date, zone: str) -> Column:
    """Week from 1, counted from `start` in the zone's calendar; NULL before it."""
    local = kickoff if zone == "UTC" else F.from_utc_timestamp(kickoff, zone)
    days = F.datediff(F.to_date(local), F.lit(start))
    return F.when(days >= 0, F.floor(days / 7).cast("int") + 1)


def trade_time(text: Column) -> Column:
    """Time of a trade line; whole seconds or exactly three decimals, else NULL."""
    return F.when(F.rlike(text, F.lit(STAMP)), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSS]'Z'")))


def number(text: Column) -> Column:
    """A double, or NULL where the text is no plain number."""
    return F.when(F.rlike(text, F.lit(NUMBER)), text.try_cast("double"))


def scraped_time(text: Column) -> Column:
    """From "Fri Nov 24 17:49:36 +0000 2023"; the weekday is not read."""
    parts = F.split(text, " ")
    return F.try_to_timestamp(F.concat_ws(" ", F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(5)), F.get(parts, F.lit(4))), F.lit("MMM dd HH:mm:ss yyyy xx"))


@F.pandas_udf(StringType())
def fold_accents(names: pd.Series) -> pd.Series:
    """Compatibility decomposition, then ASCII only: the one step without a built-in function."""
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def folded_name(ascii_name: Column) -> Column:
    words = F.split(F.regexp_replace(F.replace(F.lower(ascii_name), F.lit("-"), F.lit(" ")), "[^a-z0-9 ]", ""), " +")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*NAME_SUFFIXES)), " ")


def normalize_name(name: Column) -> Column:
    """Case, accents, punctuation and suffixes such as Jr. or III do not matter."""
    return folded_name(fold_accents(name))


def base_type(market_type: Column) -> Column:
    return F.regexp_replace(market_type, PERIOD, "")


def is_game_line(market_type: Column) -> Column:
    return base_type(market_type).isin(*GAME_LINES)


def prop_player(description: Column, market_type: Column) -> Column:
    """The player in "Some Name 89.5 RECEIVING_YARDS", NULL for game lines and other texts."""
    tail = F.concat(F.lit(" "), market_type)
    head = F.substring(description, F.lit(1), F.length(description) - F.length(tail))
    name = F.trim(F.regexp_replace(head, r" -?\d+(?:\.\d+)?$", ""))
    return F.when(~is_game_line(market_type) & F.endswith(description, tail), F.nullif(name, F.lit("")))


def first_line(text: Column) -> Column:
    """The first line of the trimmed text without links and without an attribution at its end."""
    line = F.element_at(F.split(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), "\n"), 1)
    line = F.regexp_replace(F.regexp_replace(line, r"(?U)\s*https?://\S+", ""), r"(?U)^\s+|\s+$", "")
    line = F.regexp_replace(line, r"(?U),? (?:per|via) (?:@\w+|the broadcast|[A-Z][\w.' ]+?)(?=[.:]?$)", "")
    return F.regexp_replace(line, r"(?U)^\s+|\s+$", "")


def md5_of_etag(etag: Column) -> Column:
    return F.nullif(F.regexp_extract(etag, '^"?([0-9a-f]{32})"?$', 1), F.lit(""))


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def run_cost(counts: Column, prices: Column, usage: Column, fallback: float = 0.0) -> Column:
    """Sum over charged events of count times listed price (the highest tier where there are tiers), plus usage."""

    def price(event):
        listed = F.try_element_at(prices, event)
        tiers = F.transform(F.map_values(listed["eventTieredPricingUsd"]), lambda t: t["tieredEventPriceUsd"])
        return F.coalesce(F.array_max(tiers), listed["eventPriceUsd"], F.lit(fallback))

    total = F.aggregate(F.coalesce(F.map_entries(counts), F.array().cast("array<struct<key:string,value:int>>")), F.lit(0.0), lambda s, e: s + e["value"] * price(e["key"]))
    return total + F.coalesce(usage, F.lit(0.0))


def seconds_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(1e6)


def plus(at: Column, seconds: float) -> Column:
    """A time some seconds later; keeps the kind of timestamp."""
    return at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)"))


def nearest_quantile(values: Column, q: float) -> Column:
    """Quantile of the collected values without interpolation: the value at the nearest rank, halves to the even one."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.bround(F.lit(q) * (F.size(ordered) - 1)).cast("int"))
