"""IPv4 addresses and CIDR ranges as integer columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterlens.functions._cols import ColumnLike, col

_QUAD = r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"


def ipv4_to_long(ip: ColumnLike) -> Column:
    """Dotted quad to its 32-bit number; NULL unless it is exactly four octets 0-255."""
    octets = F.split(col(ip), r"\.")
    value = [F.get(octets, F.lit(i)).try_cast("long") for i in range(4)]
    valid = col(ip).rlike(_QUAD)
    for v in value:
        valid = valid & (v <= 255)
    return F.when(valid, ((value[0] * 256 + value[1]) * 256 + value[2]) * 256 + value[3])


def block_size(prefix_length: ColumnLike) -> Column:
    """Addresses in a block of this prefix length; NULL outside 0-32."""
    n = col(prefix_length)
    return F.when(n.between(0, 32), F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(32) - n))


def network_base(address: ColumnLike, prefix_length: ColumnLike) -> Column:
    """First address of the block of that prefix length that holds the address."""
    return col(address) - F.pmod(col(address), block_size(prefix_length))


def cidr_prefix(cidr: ColumnLike) -> Column:
    """Prefix length of ``a.b.c.d/n``; a bare address is /32."""
    c = col(cidr)
    return F.when(c.contains("/"), F.substring_index(c, "/", -1).try_cast("int")).otherwise(F.lit(32))


def cidr_range(cidr: ColumnLike) -> tuple[Column, Column]:
    """Lowest and highest address of the range, NULL if it does not parse."""
    prefix = cidr_prefix(cidr)
    low = network_base(ipv4_to_long(F.substring_index(col(cidr), "/", 1)), prefix)
    return low, low + block_size(prefix) - 1


def cross_region_flag(
    source_cloud: ColumnLike, source_region: ColumnLike, target_cloud: ColumnLike, target_region: ColumnLike
) -> Column:
    return ~(
        col(source_cloud).eqNullSafe(col(target_cloud)) & col(source_region).eqNullSafe(col(target_region))
    )
