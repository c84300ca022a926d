"""Conditions on parsed packets: hosts, networks, ports and protocols as Columns, and the filter expressions that say them.

Conditions are ordinary Columns over a struct that ``packets.parse`` gives, so they combine with ``&``, ``|`` and ``~``, and Spark evaluates them.  ``matching`` parses four layers, filters, and parses
names and payloads of what is left alone.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import packets

# Protocol numbers and link types by the names that filter expressions have for them.
PROTOCOLS = {"icmp": 1, "igmp": 2, "tcp": packets.TCP, "udp": packets.UDP, "icmp6": 58, "sctp": 132}
FAMILIES = {"ip": packets.IP4, "ip6": packets.IP6, "arp": 0x0806, "rarp": 0x8035}
SIDES = {"address": ("src", "dst"), "port": ("sport", "dport")}


class Filter:
    """Conditions on the struct column ``signature``.  ``side``: src, dst, or either (empty).  A packet without the layer asked for meets no condition."""

    def __init__(self, signature: str = "sig", packet: str = "packet"):
        self.signature, self.packet = signature, packet

    def _of(self, name: str) -> Column:
        return F.col(f"{self.signature}.{name}")

    def _either(self, kind: str, side: str, test: Callable[[Column], Column]) -> Column:
        src, dst = (F.coalesce(test(self._of(c)), F.lit(False)) for c in SIDES[kind])
        return {"src": src, "dst": dst, "": src | dst}[side]

    def host(self, address: str, side: str = "") -> Column:
        raw = ipaddress.ip_address(address).packed
        return self._either("address", side, lambda c: c == F.lit(raw))

    def net(self, network: str, side: str = "") -> Column:
        n = ipaddress.ip_network(network, strict=False)
        raw, (whole, rest) = n.network_address.packed, divmod(n.prefixlen, 8)

        def inside(c: Column) -> Column:
            good = (F.octet_length(c) == len(raw)) & (F.substring(c, 1, whole) == F.lit(raw[:whole]))
            if rest:
                byte = F.conv(F.hex(F.substring(c, whole + 1, 1)), 16, 10).cast("int")
                good &= F.shiftright(byte, 8 - rest) == raw[whole] >> (8 - rest)
            return good

        return self._either("address", side, inside)

    def port(self, low: int, high: int | None = None, side: str = "") -> Column:
        return self._either("port", side, lambda c: c.between(low, low if high is None else high))

    def protocol(self, name: str) -> Column:
        test = self._of("l4_type") == PROTOCOLS[name] if name in PROTOCOLS else self._of("l3_type") == FAMILIES[name]
        return F.coalesce(test, F.lit(False))

    def vlan(self, number: int | None = None) -> Column:
        tags = self._of("vlans")
        return F.coalesce(F.size(tags) > 0 if number is None else F.exists(tags, lambda v: v.bitwiseAND(F.lit(0xFFF)) == number), F.lit(False))

    def length(self, least: int | None = None, most: int | None = None) -> Column:
        n = F.octet_length(self.packet)
        return F.coalesce((n >= least if least is not None else F.lit(True)) & (n <= most if most is not None else F.lit(True)), F.lit(False))

    def expression(self, text: str) -> Column:
        """The condition that an expression says: ``[src|dst] host A``, ``[src|dst] net A/N``, ``[src|dst] port N``, ``portrange N-M``, protocol names (also before a port), ``vlan [N]``,
        ``less N``, ``greater N``, joined by and, or, not and brackets.  And binds more than or."""
        words = re.findall(r"[()]|&&|\|\||!|[^\s()!&|]+", text.lower())
        same = {"&&": "and", "||": "or", "!": "not"}
        words = [same.get(w, w) for w in words]
        if not words:
            return F.lit(True)
        at = 0

        def peek() -> str:
            return words[at] if at < len(words) else ""

        def take(kind: str = "") -> str:
            nonlocal at
            if at == len(words):
                raise ValueError(f"{text!r} ends where {kind or 'a condition'} is due")
            at += 1
            return words[at - 1]

        def any_of() -> Column:
            out = all_of()
            while peek() == "or":
                take()
                out |= all_of()
            return out

        def all_of() -> Column:
            out = one()
            while peek() == "and":
                take()
                out &= one()
            return out

        def one() -> Column:
            w = take()
            if w == "not":
                return ~one()
            if w == "(":
                out = any_of()
                if take("a bracket") != ")":
                    raise ValueError(f"a bracket is open in {text!r}")
                return out
            if w in PROTOCOLS or w in FAMILIES:
                whole = self.protocol(w)
                return whole & one() if peek() in ("src", "dst", "host", "net", "port", "portrange") else whole
            if w == "vlan":
                return self.vlan(int(take()) if peek().isdigit() else None)
            if w in ("less", "greater"):
                n = int(take("a length"))
                return self.length(most=n) if w == "less" else self.length(least=n)
            side, kind = (w, take("what is meant")) if w in ("src", "dst") else ("", w)
            if kind in ("host", "net", "port"):
                value = take(f"a {kind}")
                return self.port(int(value), side=side) if kind == "port" else getattr(self, kind)(value, side)
            if kind == "portrange":
                low, _, high = take("a range").partition("-")
                return self.port(int(low), int(high), side)
            raise ValueError(f"{kind!r} in {text!r} is no condition")

        out = any_of()
        if at < len(words):
            raise ValueError(f"{words[at]!r} in {text!r} is one too many")
        return out


def matching(df: DataFrame, expression: str | Callable[[Filter], Column], packet: str = "packet", out: str = "sig") -> DataFrame:
    """The packets that meet an expression (or a condition made of a ``Filter``), parsed to ``out``.  Names and payloads of dropped packets are never looked at."""
    f = Filter("_l4", packet)
    condition = f.expression(expression) if isinstance(expression, str) else expression(f)
    kept = df.withColumn("_l4", packets.parse(4, keep_rest=False)(packet)).where(condition).drop("_l4")
    return kept.withColumn(out, packets.parse()(packet))
