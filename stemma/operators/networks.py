"""Membership of addresses in a table of networks, both families.

A network is the beginning of its addresses, so an address is in one if its first bits are among the
networks': one equality join for all prefix lengths that occur, 162 at most, however many networks there
are. No address is compared with every network.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut, on_workers


def _parsed(text: str | None, network: bool) -> tuple[int, int, str] | None:
    try:
        if network:
            n = ipaddress.ip_network((text or "").strip(), strict=False)
            return n.version, n.prefixlen, f"{int(n.network_address):0{n.max_prefixlen // 4}x}"
        a = ipaddress.ip_address(text or "")
        return a.version, a.max_prefixlen, f"{int(a):0{a.max_prefixlen // 4}x}"
    except ValueError:
        return None


def _parser(network: bool):
    @F.pandas_udf("version int, bits int, digits string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [_parsed(t, network) or (None, None, None) for t in texts]
        return pd.DataFrame({"version": pd.array([r[0] for r in rows], dtype="Int32"), "bits": pd.array([r[1] for r in rows], dtype="Int32"), "digits": [r[2] for r in rows]})

    return run


def _prefix(digits: Column, bits: Column) -> Column:
    """The first bits of hexadecimal digits: whole digits, and what is left of the next one."""
    whole, more = F.floor(bits / 4).cast("int"), bits % 4
    nibble = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    rest = F.when(more == 0, "").when(more == 1, F.shiftright(nibble, 3).cast("string")).when(more == 2, F.shiftright(nibble, 2).cast("string")).otherwise(F.shiftright(nibble, 1).cast("string"))
    return F.concat(F.substring(digits, F.lit(1), whole), F.lit("/"), rest)


def in_networks(df: DataFrame, ip_col: str, networks: DataFrame, cidr_col: str = "cidr") -> DataFrame:
    """Rows of df whose address is in one of the networks (a.b.c.d/n, or IPv6; an address is a network of itself).

    Blank networks do not count; where none is left, all rows are allowed. Otherwise rows without an
    address, or with what is none, are not. IPv4 addresses are in no IPv6 network and the other way round. A network
    that is none is an error.
    """
    on_workers(df.sparkSession)
    given = networks.select(F.col(cidr_col).cast("string").alias("cidr")).where(F.trim("cidr") != "").distinct()
    own = cut(given.withColumn("n", _parser(True)(F.col("cidr"))).select("cidr", "n.*"))
    bad = own.where("version is null").limit(1).collect()
    if bad:
        raise ValueError(f"no network: {bad[0]['cidr']!r}")
    kinds = sorted((r["version"], r["bits"]) for r in own.select("version", "bits").distinct().collect())  # 33 + 129 at most
    if not kinds:
        return df
    nets = own.select("version", "bits", _prefix(F.col("digits"), F.col("bits")).alias("prefix")).distinct()
    asked = df.select(F.col(ip_col).alias("_ip")).where("_ip is not null").distinct()
    read = asked.withColumn("a", _parser(False)(F.col("_ip"))).where("a.version is not null").select("_ip", F.col("a.version").alias("version"), F.col("a.digits").alias("digits"))
    lengths = F.array(*(F.struct(F.lit(v).alias("version"), F.lit(b).alias("bits")) for v, b in kinds))
    tried = read.withColumn("k", F.explode(F.filter(lengths, lambda k: k["version"] == F.col("version")))).select("_ip", "version", F.col("k.bits").alias("bits"), _prefix(F.col("digits"), F.col("k.bits")).alias("prefix"))
    allowed = tried.join(nets, ["version", "bits", "prefix"], "left_semi").select(F.col("_ip").alias(ip_col)).distinct()
    return df.join(allowed, ip_col, "left_semi").select(*df.columns)
