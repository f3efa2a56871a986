"""Which addresses anyone may reach: the longest prefix of a table, on two 64-bit halves.

An IPv4 address stands for its mapped IPv6 one, so one table holds both. For each prefix length of the table an
address gives one masked key, joined by hash with the prefixes; of those that fit the longest decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions.labels import IPV4

#: The special-purpose networks, and whether an address in them counts as public.
IPV4_NETWORKS = {"0.0.0.0/0": True, "0.0.0.0/8": False, "10.0.0.0/8": False, "100.64.0.0/10": False, "127.0.0.0/8": False, "169.254.0.0/16": False, "172.16.0.0/12": False, "192.0.0.0/24": False, "192.0.0.9/32": True, "192.0.0.10/32": True, "192.0.0.170/31": False, "192.0.2.0/24": False, "192.168.0.0/16": False, "198.18.0.0/15": False, "198.51.100.0/24": False, "203.0.113.0/24": False, "224.0.0.0/4": False, "240.0.0.0/4": False}
IPV6_NETWORKS = {"::/0": False, "2000::/3": True, "fec0::/10": True, "2001::/23": False, "2001:1::1/128": True, "2001:1::2/128": True, "2001:3::/32": True, "2001:4:112::/48": True, "2001:20::/28": True, "2001:30::/28": True, "2001:db8::/32": False, "2002::/16": False}


def _let(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value) with the value computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), made), 1)


def _as_groups(text: Column) -> Column:
    """An address with its IPv4 part, if it has one, as two groups; null if that part is no IPv4 address."""

    def written(four: Column) -> Column:
        group = lambda n, k: F.lower(F.hex(n[k] * 256 + n[k + 1]))
        tail = _let(F.transform(F.split(four, "\\."), lambda p: p.try_cast("long")), lambda n: F.concat(group(n, 0), F.lit(":"), group(n, 2)))
        known = F.when(four == text, F.concat(F.lit("::ffff:"), tail)).otherwise(F.concat(F.regexp_replace(text, "[0-9.]+$", ""), tail))
        return F.when(four.rlike(IPV4), known).when(~F.contains(four, F.lit(".")), text)

    return _let(F.regexp_extract(text, "(^|:)([0-9.]+)$", 2), written)


def _filled(whole: Column) -> Column:
    """The eight groups of an address that may leave out zeros once; null if it is none."""

    def of(sides: Column) -> Column:
        groups = lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ":"))
        left, right = groups(sides[0]), F.when(F.size(sides) == 2, groups(sides[1])).otherwise(F.array().cast("array<string>"))

        def joined(x: Column) -> Column:
            missing = 8 - F.size(x["a"]) - F.size(x["b"])
            shaped = F.when(F.size(sides) == 2, missing >= 1).otherwise((F.size(sides) == 1) & (missing == 0))
            return F.when(shaped, F.concat(x["a"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), x["b"]))

        return _let(F.struct(left.alias("a"), right.alias("b")), joined)

    eight = F.when(F.contains(whole, F.lit(":")), _let(F.split(whole, "::"), of))
    return _let(eight, lambda g: F.when(F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")), g))


def halves(address: Column) -> Column:
    """struct(hi, lo) of an address in any of its written forms (IPv4 as mapped); null if it is none."""
    text = F.lower(F.regexp_replace(address, "^([0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*)%[^%/]+$", "$1"))  # a zone names no other address
    half = lambda g, a: F.conv(F.array_join(F.transform(F.slice(g, a, 4), lambda x: F.lpad(x, 4, "0")), ""), 16, -10).cast("long")
    return _let(_filled(_let(text, _as_groups)), lambda g: F.when(g.isNotNull(), F.struct(half(g, 1).alias("hi"), half(g, 5).alias("lo"))))


def unwrapped(address: Column) -> Column:
    """The halves of the IPv4 address that a 6to4 address carries, else the address's own."""
    inner = lambda a: F.shiftrightunsigned(a["hi"], 16).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(0xFFFF << 32)).cast("long")
    return _let(address, lambda a: F.when(F.shiftrightunsigned(a["hi"], 48) == 0x2002, F.struct(F.lit(0).cast("long").alias("hi"), inner(a).alias("lo"))).otherwise(a))


def masked(half: Column, bits: Column) -> Column:
    """The first bits (0 to 64) of a half."""
    return F.when(bits <= 0, F.lit(0).cast("long")).otherwise(half.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("long"), (64 - F.least(bits, F.lit(64))).cast("int"))))


def prefix_table(networks: DataFrame) -> DataFrame:
    """bits, hi, lo and the other columns of networks (network as text, such as 10.0.0.0/8)."""
    base, bits = F.split_part("network", F.lit("/"), F.lit(1)), F.split_part("network", F.lit("/"), F.lit(2)).cast("int")
    all_bits = bits + F.when(base.rlike(IPV4), 96).otherwise(0)
    rest = [c for c in networks.columns if c != "network"]
    return networks.select(all_bits.alias("bits"), halves(base).alias("h"), *rest).select("bits", masked(F.col("h.hi"), F.col("bits")).alias("hi"), masked(F.col("h.lo"), F.col("bits") - 64).alias("lo"), *rest)


def longest_prefix(addresses: DataFrame, prefixes: DataFrame, value: str) -> DataFrame:
    """hi, lo, bits, value of the longest prefix of every distinct address (hi, lo) that has one."""
    lengths = sorted(r.bits for r in prefixes.select("bits").distinct().collect())  # 129 at most
    each = addresses.select("hi", "lo").distinct().withColumn("bits", F.explode(F.array(*map(F.lit, lengths)))) if lengths else addresses.select("hi", "lo", F.lit(0).alias("bits")).where(F.lit(False))
    keyed = each.select("hi", "lo", "bits", masked(F.col("hi"), F.col("bits")).alias("h"), masked(F.col("lo"), F.col("bits") - 64).alias("l"))
    p = prefixes.select(F.col("bits").alias("b"), F.col("hi").alias("ph"), F.col("lo").alias("pl"), value)
    met = keyed.join(p, (F.col("bits") == F.col("b")) & (F.col("h") == F.col("ph")) & (F.col("l") == F.col("pl")))
    return met.groupBy("hi", "lo").agg(F.max(F.struct("bits", value)).alias("m")).select("hi", "lo", "m.*")


def with_public(rows: DataFrame, address: str) -> DataFrame:
    """rows with `public`: whether the address is one that anyone may reach; false for what is no address."""
    spark = rows.sparkSession
    networks = spark.createDataFrame([*IPV4_NETWORKS.items(), *IPV6_NETWORKS.items()], "network string, public boolean")
    own = rows.withColumn("_a", unwrapped(halves(F.col(address))))
    known = longest_prefix(own.where("_a IS NOT NULL").select("_a.hi", "_a.lo"), prefix_table(networks), "public").select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), F.col("public").alias("_public"))
    out = own.join(known, (F.col("_a.hi") == F.col("_hi")) & (F.col("_a.lo") == F.col("_lo")), "left")
    return out.select(*rows.columns, F.coalesce("_public", F.lit(False)).alias("public"))
