"""Networks of both families against the standard library, address by address."""

import ipaddress
import random

import pytest

from stemma.operators import networks as W


def test_like_the_library(spark):
    r = random.Random(5)
    four = lambda: ".".join(str(r.choice((0, 1, 10, 127, 192, 255))) for _ in range(4))
    six = lambda: str(ipaddress.IPv6Address(r.choice((0x20010DB8 << 96, 0, 0xFFFF << 32)) | r.getrandbits(r.choice((4, 32, 70)))))
    nets = [f"{four()}/{r.randint(1, 32)}" for _ in range(25)] + [f" {six()}/{r.randint(30, 128)} " for _ in range(25)] + [four(), six(), "", "  ", None, "10.0.0.0/8"]
    asked = [four() for _ in range(150)] + [six() for _ in range(150)] + ["::ffff:10.0.0.1", "10.0.0.1", " 10.0.0.1", "nonsense", "", None, "10.0.0.256", "fe80::1%eth0", "::1"]
    known = [ipaddress.ip_network(n.strip(), strict=False) for n in nets if n and n.strip()]

    def allowed(x):
        try:
            return any(ipaddress.ip_address(x) in n for n in known)
        except ValueError:
            return False

    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(asked)], "id int, ip string, bits int").repartition(3)
    got = W.in_networks(df, "ip", spark.createDataFrame([(n, 4) for n in nets], "cidr string, version int"))
    assert got.columns == df.columns
    assert sorted(x.id for x in got.collect()) == [i for i, x in enumerate(asked) if x and allowed(x)]


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "1.2.3.4"), (2, None)], "id int, ip string")
    nets = lambda *x: spark.createDataFrame([(n,) for n in x], "cidr string")
    assert W.in_networks(df, "ip", nets()).count() == W.in_networks(df, "ip", nets(" ", None)).count() == 2
    assert [x.id for x in W.in_networks(df, "ip", nets("0.0.0.0/0")).collect()] == [1]
    assert W.in_networks(df.limit(0), "ip", nets("1.2.3.4")).count() == 0
    with pytest.raises(ValueError):
        W.in_networks(df, "ip", nets("1.2.3.4/33"))
