"""Property access, filters and network text."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Property names that live in their own column.
PROPERTY_COLUMNS = {
    "country": "country_code",
    "city": "city",
    "os": "os_family",
    "device_type": "platform",
    "platform": "platform",
    "browser": "browser",
    "app_version": "app_version",
    "campaign_id": "campaign_id",
    "install_source": "install_source",
}


def prop(key: str) -> Column:
    """Property value; a missing key reads as the empty string."""
    return F.coalesce(F.col("props")[key], F.lit(""))


def property_value(name: str) -> Column:
    """A fact column when the property has one, else the props entry."""
    column = PROPERTY_COLUMNS.get(name)
    return prop(name) if column is None else F.coalesce(F.col(column), F.lit(""))


def not_blank(col: str | Column) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col, F.lit("")) != ""


@dataclass(frozen=True)
class PropertyFilter:
    """``eq``, ``neq`` or ``contains`` (case-insensitive) on a property."""

    property: str
    operator: str
    value: str

    def column(self) -> Column:
        value = property_value(self.property)
        if self.operator == "eq":
            return value == self.value
        if self.operator == "neq":
            return value != self.value
        if self.operator == "contains":
            return F.contains(F.lower(value), F.lower(F.lit(self.value)))
        raise ValueError(f"unknown filter operator {self.operator!r}")


def all_filters(filters: Iterable[PropertyFilter]) -> Column:
    return reduce(lambda a, b: a & b, (f.column() for f in filters), F.lit(True))


def ipv4_to_long(ip: Column) -> Column:
    """Dotted quad to integer; null for anything that is not IPv4."""
    parts = F.split(ip, r"\.")
    octets = [parts[i].try_cast("bigint") for i in range(4)]
    number = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    return F.when(is_ipv4(ip), number)


def is_ipv4(ip: Column) -> Column:
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return ip.rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$")


def is_ipv6(ip: Column) -> Column:
    return ip.rlike(r"^[0-9a-fA-F:]*:[0-9a-fA-F:]*:[0-9a-fA-F:.]*$")


# How the 32 digits of an IPv4 address begin (``::ffff:a.b.c.d``).
IPV4_DIGITS = "0" * 20 + "ffff"


def ip_to_hex(ip: Column) -> Column:
    """Address of either family as 32 hexadecimal digits, IPv4 in its mapped form; null for anything else."""
    lowered = F.lower(ip)
    number = ipv4_to_long(F.regexp_extract(lowered, r":([0-9.]+)$", 1))
    whole = F.when(number.isNotNull(), F.concat(
        F.regexp_extract(lowered, r"^(.*:)[0-9.]+$", 1), F.lower(F.hex(F.shiftright(number, 16))), F.lit(":"), F.lower(F.hex(number.bitwiseAND(65535))),
    )).otherwise(lowered)
    halves = F.split(whole, "::")
    groups = [F.array_remove(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), "") for i in (0, 1)]
    missing = F.when(F.size(halves) == 2, 8 - F.size(groups[0]) - F.size(groups[1])).otherwise(0)
    every = F.concat(groups[0], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), groups[1])
    right = (F.size(every) == 8) & (F.size(halves) <= 2) & F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    six = F.when(right, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))
    four = F.concat(F.lit(IPV4_DIGITS), F.lower(F.lpad(F.hex(ipv4_to_long(ip)), 8, "0")))
    return F.when(is_ipv4(ip), four).when(F.contains(lowered, F.lit(":")), six)
