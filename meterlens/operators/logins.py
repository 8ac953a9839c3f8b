"""Logins, sessions and the network they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlens.functions import (
    Lookback,
    base_client_name,
    cidr_range,
    default_label,
    ipv4_to_long,
    network_base,
    safe_percent,
    yes_no_to_bool,
)
from meterlens.functions.labels import UNKNOWN
from meterlens.functions.network import cidr_prefix
from meterlens.operators.ranking import merge_one_row

UNMATCHED = "Unmatched"


def w_sessions_by_client(sessions: DataFrame, window: Lookback) -> DataFrame:
    return (
        sessions.filter(window.ts("created_on"))
        .groupBy(base_client_name("client_application_id").alias("client_application_id"))
        .agg(F.count(F.lit(1)).alias("session_count"))
    )


def logins_by_ip(logins: DataFrame, window: Lookback) -> DataFrame:
    return logins.filter(window.ts("event_timestamp")).groupBy("client_ip").agg(F.count(F.lit(1)).alias("login_count"))


#: Ranges and addresses meet by blocks of this many addresses.
BLOCK = 1 << 16


def channel_ranges(policies: DataFrame) -> DataFrame:
    """``low, high, channel``: disjoint ranges of addresses, each with the first policy in priority order that holds it.

    Between two neighbouring ends of policies nothing changes, so a policy is looked for at the ends alone: once per
    prefix length in use (33 at most), by the base of the end's block.  Neighbouring ranges of one channel are one
    range; the addresses that no policy holds are in none.
    """
    low, high = cidr_range("cidr")
    networks = policies.select("channel", "priority", cidr_prefix("cidr").alias("prefix"), low.alias("base"), high.alias("high"))
    networks = networks.filter(F.col("base").isNotNull())
    # the channel goes with its priority: policies may share one
    first = networks.groupBy("prefix", "base").agg(F.min(F.struct("priority", "channel")).alias("policy"))
    prefixes = networks.select(F.collect_set("prefix")).scalar()
    ends = networks.select(F.explode(F.array("base", F.col("high") + 1)).alias("low")).distinct()
    held = (
        ends.select("low", F.explode(prefixes).alias("prefix"))
        .withColumn("base", network_base("low", "prefix"))
        .join(first, ["prefix", "base"], "left")
        .groupBy("low")
        .agg(F.min("policy").alias("policy"))
    )
    # one row per end of a policy, not per address
    order = Window.partitionBy(F.lit(0)).orderBy("low")
    changed = held.withColumn("_before", F.lag("policy").over(order)).filter(
        ~F.col("policy.channel").eqNullSafe(F.col("_before.channel")) | (F.col("policy").isNull() != F.col("_before").isNull())
    )
    ranges = changed.withColumn("high", F.lead("low").over(order) - 1)
    return ranges.filter(F.col("policy").isNotNull()).select("low", "high", F.col("policy.channel").alias("channel"))


def login_channel(by_ip: DataFrame, policies: DataFrame) -> DataFrame:
    """Channel of each address: the first policy in priority order whose range holds it.

    Policies become disjoint ranges once (:func:`channel_ranges`); each address then takes the last range that begins
    at or before it.  Both are dealt out by blocks of 65,536 addresses, which bounds what an ordered window meets, so
    an address is shuffled once, whatever number of prefix lengths there is.  The input has one row per distinct
    address and is not joined to itself.
    """
    ranges = channel_ranges(policies)
    spread = ranges.select("*", F.explode(F.sequence(F.floor(F.col("low") / BLOCK), F.floor(F.col("high") / BLOCK))).alias("block"))
    begins = spread.select(
        "block", F.greatest(F.col("low"), F.col("block") * BLOCK).alias("at"), F.struct("high", "channel").alias("range")
    )
    address = ipv4_to_long("client_ip")
    # addresses that do not parse are dealt by their text, not all to one task
    block = F.coalesce(F.floor(address / BLOCK), -1 - F.pmod(F.xxhash64("client_ip"), F.lit(BLOCK)))
    logins = by_ip.select("client_ip", "login_count", block.alias("block"), address.alias("at"), F.lit(True).alias("login"))
    order = Window.partitionBy("block").orderBy("at", F.col("login").asc_nulls_first())
    found = logins.unionByName(begins, allowMissingColumns=True).withColumn("range", F.last("range", ignorenulls=True).over(order))
    matched = found.filter("login").withColumn("channel", F.when(F.col("at") <= F.col("range.high"), F.col("range.channel")))
    return matched.select("client_ip", _channel_label().alias("channel"), "login_count")


def _channel_label() -> Column:
    blank = F.coalesce(F.col("client_ip") == "", F.lit(True))
    return F.when(blank, UNKNOWN).otherwise(F.coalesce("channel", F.lit(UNMATCHED)))


def w_logins_by_channel(channels: DataFrame) -> DataFrame:
    return channels.groupBy("channel").agg(F.sum("login_count").alias("login_count"))


def w_logins_by_client_type(logins: DataFrame, window: Lookback) -> DataFrame:
    return (
        logins.filter(window.ts("event_timestamp"))
        .groupBy(default_label("reported_client_type", blank_too=True).alias("client_type"))
        .agg(F.count(F.lit(1)).alias("login_count"))
    )


def w_auth_factors(logins: DataFrame, window: Lookback) -> DataFrame:
    return (
        logins.filter(window.ts("event_timestamp"))
        .groupBy(
            default_label("first_authentication_factor").alias("first_factor"),
            F.col("second_authentication_factor").alias("second_factor"),
            yes_no_to_bool("is_success").alias("is_success"),
        )
        .agg(F.count(F.lit(1)).alias("login_count"))
    )


def login_shares(by_channel: DataFrame, by_client_type: DataFrame, channel: str, client_type: str) -> DataFrame:
    """One row: percent of logins through one channel and from one client type."""
    def share(rows: DataFrame, key: str, value: str, alias: str) -> DataFrame:
        part = F.sum(F.when(F.col(key) == value, F.col("login_count")))
        total = F.coalesce(F.sum("login_count"), F.lit(0))
        return rows.agg(F.round(safe_percent(F.coalesce(part, F.lit(0)), total), 6).alias(alias))

    return merge_one_row(
        share(by_channel, "channel", channel, "channel_percent"),
        share(by_client_type, "client_type", client_type, "client_type_percent"),
    )


def w_login_total(logins: DataFrame, window: Lookback) -> DataFrame:
    return logins.filter(window.ts("event_timestamp")).agg(F.count(F.lit(1)).alias("total_logins"))
