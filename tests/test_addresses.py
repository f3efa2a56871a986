"""Addresses against the standard library's registry."""

import ipaddress
import random

from pyspark.sql import functions as F

from basalt.operators import addresses


def plain(text):
    try:
        ip = ipaddress.ip_address(text or "")
    except ValueError:
        return False
    if ip.version == 6:
        ip = ip.ipv4_mapped or ip.sixtofour or ip
    return ip.is_global and not ip.is_reserved and not ip.is_multicast


def test_as_the_registry(spark):
    rng = random.Random(4)
    networks = [*addresses.IPV4_NETWORKS, *addresses.IPV6_NETWORKS, "::/8", "64:ff9b::/96", "100::/64", "fc00::/7", "fe80::/10", "ff00::/8", "4000::/3"]
    given = [None, "", "::", "::1", "1::", ":::", "1:2", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2::3", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::8", "2600::g", "2600::12345", "::ffff:8.8.8.8", "::FFFF:10.0.0.1", "::ffff:8.8.8.256", "2600::8.8.8.8", "1.2.3", "01.2.3.4", "8.8.8.8", "fe80::1%eth0", "2600::1%", "2002:a9fe:a9fe::", "2002:808:808::1", " ::1", "2600::1/64", "8.8.8.8%1", "fec0::1", "2600:::1", "2600::1:"]
    for n in networks:
        net = ipaddress.ip_network(n)
        first, last = int(net.network_address), int(net.broadcast_address)
        for at in {first, last, first - 1, last + 1, rng.randint(first, last)}:
            if 0 <= at < 1 << net.max_prefixlen:
                ip = (ipaddress.IPv4Address if net.version == 4 else ipaddress.IPv6Address)(at)
                given += [str(ip), ip.exploded.upper()]
    given += [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(given)), "id long, address string")
    got = {r.id: r.public for r in addresses.with_public(rows, "address").collect()}
    assert {k: x for k, x in enumerate(given) if got[k] != plain(x)} == {}


def test_longest_prefix(spark):
    table = addresses.prefix_table(spark.createDataFrame([("::/0", "all"), ("10.0.0.0/8", "ten"), ("10.1.0.0/16", "ten one"), ("2600::/12", "x")], "network string, name string"))
    rows = spark.createDataFrame([("10.1.2.3",), ("10.2.2.3",), ("2601::",), ("1::",)], "a string").select("a", addresses.halves(F.col("a")).alias("h")).select("a", "h.*")
    found = addresses.longest_prefix(rows, table, "name")
    assert {r.a: (r.bits, r.name) for r in rows.join(found, ["hi", "lo"]).collect()} == {"10.1.2.3": (112, "ten one"), "10.2.2.3": (104, "ten"), "2601::": (12, "x"), "1::": (0, "all")}
    assert addresses.longest_prefix(rows, table.limit(0), "name").count() == 0
