import io
import os
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import filters, packets
from tidemark.operators import dns, flows, intervals
from tidemark.sources import archive, captures, flow_csv, synthetic
from tidemark.streaming import conversations as talks
from tidemark.streaming import intervals as live
from tidemark.streaming import late as lates


def tcp(a, b, sport, dport, seq, ack, flags, data=b"", pad=b""):
    head = struct.pack(">HHIIBBHHH", sport, dport, seq % 2**32, ack % 2**32, 5 << 4, flags, 1000, 0, 0)
    head = head[:16] + struct.pack(">H", packets.tcp_checksum(a, b, head + data)) + head[18:]
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 40 + len(data), 0, 0x4000, 64, 6, 0) + a + b
    return b"\2" * 12 + b"\x08\0" + ip + head + data + pad


def udp_dns(names, flags=0, answers=0, extra=b""):
    q = b"".join(bytes([len(x)]) + x for x in names) + b"\0" + struct.pack(">HH", 1, 1)
    a = (b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 60, 4) + b"\1\2\3\4") * answers
    dns = struct.pack(">6H", 7, flags, 1, answers, 0, 0) + q + a + extra
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 28 + len(dns), 0, 0, 64, 17, 0) + bytes(8)
    return b"\2" * 12 + b"\x81\0\0\x05\x08\0" + ip + struct.pack(">HHHH", 5000, 53, 8 + len(dns), 0) + dns


A, B = bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])


def test_layers():
    s = packets.signature(tcp(A, B, 1, 80, 5, 6, 0x18, b"hello", b"\0\0"))
    assert (s["src"], s["dst"], s["sport"], s["dport"], s["seq"], s["ack"], s["flags"], s["rest"]) == (A, B, 1, 80, 5, 6, 24, b"hello")
    d = packets.signature(udp_dns([b"WWW", b"example", b"com"], answers=1, extra=b"x"))
    assert (d["vlans"], d["dns_query"], d["dns_answered"], d["dns_slack"], d["dns_query_len"]) == ([5], "com.example.www", True, True, 17)
    assert packets.signature(udp_dns([b"a"], flags=0x40))["dns_query"] is None
    for cut in range(len(tcp(A, B, 1, 80, 5, 6, 0x18))):
        packets.signature(udp_dns([b"www", b"x"])[:cut])
    assert packets.signature(None)["l3_type"] is None and packets.signature(b"")["rest"] is None
    # A pointer to itself, or a second pointer, is malformed.
    assert packets.dns_name(b"\xc0\x00", 0) is None and packets.dns_name(b"\1a\xc0\x04\xc0\x00", 0) is None


def test_batches_are_parsed_like_single_packets():
    """Whole, cut and damaged packets of all kinds, and slices of a batch."""
    rng = np.random.default_rng(6)
    six = b"\2" * 12 + b"\x86\xdd" + b"\x60\0\0\0" + struct.pack(">HBB", 8, 17, 64) + bytes(range(32)) + struct.pack(">HHHH", 9, 53, 8, 0) + b"pad"
    kinds = [tcp(A, B, 1, 80, 5, 6, 0x18, b"hello", b"\0\0"), udp_dns([b"WWW", b"example", b"com"], answers=1, extra=b"x"), udp_dns([b"a"], flags=0x40), six, b"\1\x80\xc2\0\0\0" + b"\2" * 6 + b"\x08\0" + bytes(60), b"\2" * 12 + b"\x81\0\0\x01\x91\0\0\x02\x08\x06" + bytes(30)]
    rows = [None, b"", *kinds, *(k[:cut] for k in kinds for cut in range(0, len(k), 3))]
    for k in kinds:
        for _ in range(150):
            p = bytearray(k)
            for _ in range(rng.integers(1, 4)):
                p[rng.integers(0, len(p))] = rng.integers(0, 256)
            rows.append(bytes(p))
    for layers, rest in ((7, True), (4, True), (3, False), (2, True)):
        got = packets.signatures(pa.array(rows, pa.binary()), layers, rest).to_pylist()
        want = [packets.signature(p, layers, rest) for p in rows]
        # A packet without a link layer has nothing, whatever is kept.
        assert got == want
    assert packets.signatures(pa.array(rows, pa.binary())[5:40]).to_pylist() == [packets.signature(p) for p in rows[5:40]]
    assert packets.signatures(pa.array([], pa.binary())).to_pylist() == []


def test_checksum():
    seg = tcp(A, B, 1, 80, 5, 6, 0x18, b"odd")[34:]
    words = struct.unpack(">14H", A + B + struct.pack(">BBH", 0, 6, len(seg)) + seg[:16])
    total = sum(words) + sum(struct.unpack(">4H", seg[16:] + b"\0"))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    assert total == 0xFFFF


def test_checksums_of_batches():
    rng = np.random.default_rng(4)
    good = [tcp(A, B, int(rng.integers(1, 9999)), 80, int(rng.integers(0, 2**32)), 6, 0x18, bytes(rng.integers(0, 256, int(rng.integers(0, 40))).tolist()), b"pad" * int(rng.integers(0, 2))) for _ in range(50)]
    six = b"\2" * 12 + b"\x86\xdd" + struct.pack(">IHBB", 6 << 28, 25, 6, 64) + bytes(15) + b"\1" + bytes(15) + b"\2"
    seg = struct.pack(">HHIIBBHHH", 1, 2, 3, 4, 5 << 4, 16, 9, 0, 0) + b"hello"
    six += seg[:16] + struct.pack(">H", packets.tcp_checksum(bytes(15) + b"\1", bytes(15) + b"\2", seg)) + seg[18:]
    tagged = good[0][:12] + b"\x81\0\0\x05" + good[0][12:]
    bad = [g[:-1] + bytes([g[-1] ^ 1]) for g in (good[0][:54] + b"z", tcp(A, B, 1, 2, 3, 4, 16, b"abc"))]
    column = pa.array([*good, six, tagged, bad[1], None, udp_dns([b"a"]), b"x", good[3]], pa.binary())
    assert packets.checksums(column).to_pylist() == [True] * 52 + [False, None, None, None, True]
    assert packets.checksums(column[5:9]).to_pylist() == [True] * 4 and packets.checksums(column[:0]).to_pylist() == []


def test_filter_expressions(spark):
    names = {"tcp": tcp(A, B, 1000, 80, 5, 6, 0x18, b"x"), "dns": udp_dns([b"a"]), "cut": b"\0" * 20, "none": None}
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in names.items()], "name string, packet binary")
    met = lambda e: {r.name for r in filters.matching(df, e).collect()}
    assert met("") == set(names) and met("tcp") == {"tcp"} and met("udp port 53 or host 10.0.0.2") == {"tcp", "dns"}
    assert met("not (tcp or udp)") == {"cut", "none"} and met("src host 10.0.0.2") == set() and met("dst net 10.0.0.0/30 and src portrange 999-1001") == {"tcp"}
    assert met("vlan") == met("vlan 5") == {"dns"} and met("vlan 6") == set() and met("less 20") == {"cut"} and met("ip and not vlan") == {"tcp"} and met("net ::/0") == set()
    assert met(lambda f: f.port(80) & ~f.host("10.0.0.9")) == {"tcp"} and met("tcp or udp and port 99") == {"tcp"}
    for wrong in ("host", "port 80 port 81", "(tcp", "colour red", "tcp and"):
        with pytest.raises(ValueError):
            filters.Filter().expression(wrong)


def test_captures(spark, tmp_path):
    rows = [(i * 1_500_000, bytes([i]) * i) for i in range(20)]
    (tmp_path / "a.pcap").write_bytes(captures.dump(rows))
    (tmp_path / "b.pcap").write_bytes(captures.dump(rows)[:-3])
    big = b"".join(struct.pack(">IIII", us // 10**6, us % 10**6, len(p), len(p)) + p for us, p in rows)
    (tmp_path / "c.pcap").write_bytes(struct.pack(">IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + big)
    (tmp_path / "d.pcap").write_bytes(b"")
    want = sorted(rows * 2 + rows[:-1])
    assert sorted((r.ts_us, bytes(r.packet)) for r in captures.read(spark, str(tmp_path), glob="*.pcap").collect()) == want
    spark.dataSource.register(captures.CaptureSource)
    assert sorted((r.ts_us, bytes(r.packet)) for r in spark.read.format("capture").load(f"file://{tmp_path}").collect()) == want
    got = live.drain(captures.stream(spark, str(tmp_path), glob="*.pcap"), str(tmp_path / "out"))
    assert got.count() == len(want)
    with pytest.raises(ValueError):
        list(captures.packets(io.BytesIO(b"x" * 30)))


@pytest.mark.parametrize("order", ["<", ">"])
def test_split_and_damaged_captures(spark, tmp_path, order, monkeypatch):
    """A capture cut into many parts gives each record once, also where packets hold captures; damage is told and stepped over."""
    rng = np.random.default_rng(2)
    inner = captures.dump([(i, bytes(20)) for i in range(60)])[24:]
    bodies = [inner[: int(rng.integers(1, len(inner)))] if rng.random() < 0.3 else bytes(rng.integers(0, 256, int(rng.integers(0, 900))).tolist()) for _ in range(400)]
    rows = [(1_700_000_000_000_000 + i * 777, b) for i, b in enumerate(bodies)]
    head = struct.pack(f"{order}IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 4000, 1)
    parts = [struct.pack(f"{order}IIII", us // 10**6, us % 10**6, len(b), len(b)) + b for us, b in rows]
    whole = head + b"".join(parts)
    monkeypatch.setattr(captures.Bytes, "STEP", 5000)
    want = list(captures.packets(io.BytesIO(whole)))
    assert [(r[1], r[4]) for r in want] == rows and not list(captures.damage(io.BytesIO(whole)))
    for n in (2, 7, 60):
        cuts = [len(whole) * i // n for i in range(n + 1)]
        assert [r for a, b in zip(cuts, cuts[1:]) for r in captures.packets(io.BytesIO(whole), a, b)] == want
    starts = np.cumsum([24, *map(len, parts)])
    bad = bytearray(whole)
    bad[starts[50] + 8 : starts[50] + 12] = b"\xff" * 4  # a length
    bad[starts[200] : starts[203] + 16] = b"\xee" * int(starts[203] + 16 - starts[200])  # over borders
    bad = bytes(bad[:-7])  # cut
    got = [(r[0], r[1]) for r in captures.packets(io.BytesIO(bad))]
    assert got == [(int(starts[i]), rows[i][0]) for i in range(399) if i not in (50, 200, 201, 202, 203)]
    lost = list(captures.damage(io.BytesIO(bad)))
    assert lost == [(starts[50], len(parts[50])), (starts[200], starts[204] - starts[200]), (starts[399], len(bad) - starts[399])]
    cuts = [len(bad) * i // 13 for i in range(14)]
    both = [captures.packets, captures.damage]
    assert all([r for a, b in zip(cuts, cuts[1:]) for r in f(io.BytesIO(bad), a, b)] == list(f(io.BytesIO(bad))) for f in both)
    (tmp_path / "bad.pcap").write_bytes(bad)
    spark.dataSource.register(captures.CaptureSource)
    load = lambda kind: spark.read.format("capture").option("kind", kind).option("split", len(bad) // 7 + 1).load(f"file://{tmp_path}/bad.pcap")
    assert load("packets").rdd.getNumPartitions() == 7 and sorted((r.record, r.ts_us) for r in load("packets").collect()) == got
    assert sorted((r.offset, r.length) for r in load("damage").collect()) == lost
    assert captures.read(spark, str(tmp_path), "damage").count() == 3


def test_flow_export(spark, tmp_path):
    rec = struct.pack(">IIIHHIIIIHHBBBBHHBBH", 1, 2, 0, 0, 0, 9, 900, 100, 400, 40000, 53, 0, 2, 17, 0, 64500, 64501, 0, 0, 0)
    (tmp_path / "f").write_bytes((struct.pack(">HHIIIIBBH", 5, 2, 0, 1700, 0, 0, 0, 0, 0) + rec * 2) * 2)
    r = captures.read(spark, str(tmp_path), "flows").orderBy("record").collect()
    assert len(r) == 4 and (r[3].packets, r[3].octets, r[3].src_port, r[3].dst_as, r[3].last_ms - r[3].first_ms) == (9, 900, 40000, 64501, 300)


def test_flow_csv(spark, tmp_path):
    good = ["3", "1.2.3.4", "300.1.1.1", "80", "81", "1.5", "2.5", *map(str, range(7, 39)), "1/2", "3/4"]
    (tmp_path / "f.csv").write_text("\n".join(["# heading"] * 10 + [",".join(good), ",".join(good[:12]), ",".join(["4", "a", "b", "x", *good[4:]]), ""]))
    r = flow_csv.read(spark, str(tmp_path)).collect()
    assert [x.valid for x in r] == [True, False, False]
    assert (r[0].a_addr, r[0].b_addr, r[0].bytes_a2b, r[0].syns_a2b, r[0].fins_b2a) == (0x01020304, None, 25, 1, 4)


def test_archive(spark, tmp_path):
    df = spark.range(3000, numPartitions=3).select("id", F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).cast("binary").alias("p"))
    at = str(tmp_path / "a")
    assert archive.write(df, "p", at, skip=F.col("id") < 1000) == 2000 and archive.write(df.where("id < 10"), "p", at) == 10
    got = sorted(len(r.payload) for r in archive.read(spark, at).collect())
    assert got == sorted(i % 7 for i in [*range(1000, 3000), *range(10)])
    assert archive.write(df.where("id < 0"), "p", at, append=False) == 0 and archive.read(spark, at).count() == 0


def talk(seed, loss=False):
    """(packets, bytes each way) of one conversation whose segments come out of order, twice, and wrap around."""
    rng = np.random.default_rng(seed)
    isn = [2**32 - 50, 7]
    text = [bytes(rng.integers(0, 256, 400).tolist()), bytes(rng.integers(0, 256, 90).tolist())]
    ends = [(A, B, 1000, 80), (B, A, 80, 1000)]
    at, out = [0, 0], [(0, 0, 0, 2, b""), (1, 0, 1, 18, b"")]
    while at[0] < 400 or at[1] < 90:
        side = int(rng.integers(0, 2))
        n = min(int(rng.integers(1, 60)), len(text[side]) - at[side])
        cuts = [(at[side], n // 2), (at[side] + n // 2, n - n // 2)]
        cuts = cuts[::-1] if rng.random() < 0.5 else cuts
        cuts = cuts[:1] if loss and at[0] > 200 and n > 3 else [*cuts, cuts[0]]
        out += [(side, 1 + o, 1 + at[1 - side], 16, text[side][o : o + k]) for o, k in cuts if k]
        at[side] += n
        out.append((1 - side, 1 + at[1 - side], 1 + at[side], 16, b""))
    out += [(0, 401, 91, 17, b""), (1, 91, 402, 17, b""), (0, 402, 92, 16, b"")]
    return [tcp(*ends[s], isn[s] + q, isn[1 - s] + k, f, d) for s, q, k, f, d in out], text


@pytest.mark.parametrize("way", ["batch", "stream"])
def test_conversations(spark, tmp_path, way):
    whole, text = talk(3)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pcap").write_bytes(captures.dump([(1_700_000_000_000_000 + i * 1000, p) for i, p in enumerate(whole)]))
    read = captures.read(spark, str(tmp_path / "in")) if way == "batch" else captures.stream(spark, str(tmp_path / "in"))
    keyed = flows.keyed(read.withColumn("sig", packets.parse()("packet")))
    if way == "batch":
        events = flows.conversations(keyed).collect()
    else:
        events = live.drain(talks.conversations(keyed.withColumn("ts", F.timestamp_micros("ts_us")), "ts"), str(tmp_path / "out")).collect()
    assert [e.reason for e in events if e.kind == "end"] == ["FIN"] and sum(e.kind == "start" for e in events) == 1
    first = next(e.direction for e in events if e.kind == "start")
    for side in (0, 1):
        data = sorted((e.offset, bytes(e.data)) for e in events if e.kind == "data" and e.direction == (first if side == 0 else 1 - first))
        assert b"".join(d for _, d in data) == text[side]


def test_conversations_over_batches(spark, tmp_path):
    """Packets of several conversations dealt to many micro-batches: the same events as in batch, data that waits over batches, and a timeout of what idles."""
    whole, lost = talk(3)[0], talk(5, loss=True)[0]
    swap = lambda p, n: p[:26] + bytes([10, 0, 0, n]) + p[30:]  # noqa: E731  another first address
    rows = [(1_700_000_000_000_000 + i * 1000, p) for i, p in enumerate(whole)] + [(1_700_000_000_000_500 + i * 1000, swap(p, 9) if p[26:30] == A else p[:30] + bytes([10, 0, 0, 9]) + p[34:]) for i, p in enumerate(lost)]
    rows += [(1_700_000_000_000_700, tcp(A, B, 7, 80, 5, 0, 2)), (1_700_000_060_000_000, tcp(B, A, 9, 80, 5, 0, 2))]
    rows.sort()
    (tmp_path / "in").mkdir()
    for i in range(0, len(rows), 40):
        (tmp_path / "in" / f"{i:04d}.pcap").write_bytes(captures.dump(rows[i : i + 40]))
        os.utime(tmp_path / "in" / f"{i:04d}.pcap", (10**9 + i, 10**9 + i))  # a stream takes the oldest file first
    batch = flows.conversations(flows.keyed(captures.read(spark, str(tmp_path / "in")).withColumn("sig", packets.parse()("packet")).withColumn("record", F.col("ts_us")))).collect()
    keyed = flows.keyed(captures.stream(spark, str(tmp_path / "in"), files_a_trigger=1).withColumn("sig", packets.parse()("packet")).withColumn("record", F.col("ts_us")))
    stream = live.drain(talks.conversations(keyed.withColumn("ts", F.timestamp_micros("ts_us")), "ts"), str(tmp_path / "out")).collect()
    last = {e.conversation for e in batch if e.ts_us >= 1_700_000_060_000_000}  # begins at the end of the input: only batch says that it idles
    plain = lambda es: sorted((e.conversation, e.ts_us, e.kind, e.offset if e.offset is not None else -1, bytes(e.data or b""), e.reason or "") for e in es if e.conversation not in last)
    assert plain(stream) == plain(batch) and {e.reason for e in stream if e.kind == "end"} == {"FIN", "MISSING_PACKET", "TIMEOUT"}


def test_chunks_in_order():
    chunk = lambda *ts: pd.DataFrame({"ts_us": ts, "order": 0})
    got = [c["ts_us"].tolist() for c in talks.in_order(iter([chunk(2, 1), chunk(), chunk(3, 5), chunk(4), chunk(9)]))]
    assert got == [[1, 2], [3, 4, 5], [9]]


def test_endings():
    c = flows.Conversation("x")
    assert [e[1] for e in c.packet(0, 0, 1, 0, 2, b"")] == ["start"]
    assert [e[6] for e in c.packet(20_000_000, 0, 1, 0, 2, b"")] == ["TIMEOUT", None]
    assert c.packet(20_000_001, 1, 1, 0, 4, b"")[-1][6] == "RST" and c.packet(20_000_002, 1, 1, 0, 4, b"") == []
    lost = flows.Conversation("y")
    got = [e for i, p in enumerate(talk(5, loss=True)[0]) for s in [packets.signature(p)] for e in lost.packet(i, int(s["src"] > s["dst"]), s["seq"], s["ack"], s["flags"], s["rest"])]
    assert got[-1][6] == "MISSING_PACKET"


def test_captures_to_statistics(spark, tmp_path):
    """Captures in a folder, in batch and as a stream: dispatch and statistics of intervals."""
    names = [[b"www", b"example", b"com"], [b"mail", b"example", b"com"], [b"www", b"example", b"org"], [b"www", b"example", b"com"]]
    rows = [(i * 1000_000, udp_dns(n)) for i, n in enumerate(names)] + [(5_000_000, udp_dns([b"a", b"b"], answers=1)), (6_000_000, tcp(A, B, 1, 80, 5, 6, 0x18, b"x")), (7_000_000, udp_dns([b"a"], flags=0x40))]
    rows += [(3_600_000_000 + us, p) for us, p in rows[:2]] + [(90_000_000_000, udp_dns([b"z"]))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pcap").write_bytes(captures.dump(rows))
    routed = lambda df: dns.dispatch(df.withColumn("sig", packets.parse()("packet")))
    batch = routed(captures.read(spark, str(tmp_path / "in")))
    assert [(r.route, r.sig.dns_query) for r in batch.where("ts_us < 10000000").orderBy("ts_us").collect()] == [("valid", "com.example.www"), ("valid", "com.example.mail"), ("valid", "org.example.www"), ("valid", "com.example.www"), ("invalid", None)]
    found = {(r.start_us, r.domain): (r.total_queries, r.subdomains, r.entropy) for r in dns.query_statistics(batch, "ts_us", 3600).collect()}
    assert found[0, "com.example"] == (3, 2, 0.918296) and found[3_600_000_000, "com.example"] == (2, 2, 1.0)
    assert [(r.total, r.unique_keys) for r in dns.payload_statistics(batch, "ts_us", 3600).collect()] == [(1, 1)]
    sides = {(r.start_us, r.side): r.unique_keys for r in dns.address_statistics(captures.read(spark, str(tmp_path / "in")).withColumn("sig", packets.parse()("packet")), "ts_us", 3600).collect()}
    assert sides[0, "src"] == 2
    stream = routed(captures.stream(spark, str(tmp_path / "in"))).where("route = 'valid'").select(F.timestamp_micros("ts_us").alias("ts"), F.col("sig.dns_query").alias("name"))
    live_rows = {r.start_us: (r.total, r.unique_keys, r.entropy) for r in live.drain(live.entropy(stream, "ts", "name", 3600, "1 second"), str(tmp_path / "out")).collect()}
    # Append mode gives closed intervals; the event at the epoch itself counts as late.
    assert live_rows[3_600_000_000] == (2, 2, 1.0) and live_rows[0][1] == 3


def test_addresses(spark):
    df = spark.createDataFrame([(bytes([10, 0, 255, 1]),), (bytes(15) + b"\1",), (b"x",), (None,)], "a binary")
    assert [r[0] for r in df.select(packets.address(F.col("a"))).collect()] == ["10.0.255.1", "0:0:0:0:0:0:0:1", None, None]


def test_captures_are_written_and_merged(spark, tmp_path):
    """Two captures merged by time, concatenated into files that follow each other."""
    for name, step in (("a", 3), ("b", 5)):
        (tmp_path / f"{name}.pcap").write_bytes(captures.dump([(i * step * 1000, bytes([i]) * 4) for i in range(60)]))
    parts = [captures.read(spark, str(tmp_path), glob=f"{n}.pcap") for n in "ab"]
    merged = intervals.merge_sorted(parts, "ts_us", "record")
    out = tmp_path / "out"
    assert captures.write(merged, str(out)) == 120
    got = [r for f in sorted(out.glob("*.pcap")) for r in captures.packets(io.BytesIO(f.read_bytes()))]
    want = sorted((i * s * 1000, k, bytes([i]) * 4) for k, s in enumerate((3, 5)) for i in range(60))
    assert [(us, p) for _, us, _, _, p in got] == [(us, p) for us, _, p in want] and not list(out.glob("*.part"))


def test_flow_records(spark, tmp_path):
    whole, _ = talk(3)
    (tmp_path / "a.pcap").write_bytes(captures.dump([(1_700_000_000_000_000 + i * 1000, p) for i, p in enumerate(whole)]))
    events = flows.conversations(flows.keyed(captures.read(spark, str(tmp_path)).withColumn("sig", packets.parse()("packet"))))
    flows.write(events, str(tmp_path / "flows"))
    got = spark.read.parquet(str(tmp_path / "flows"))
    codes = [r.code for r in got.orderBy("secs", "micros").collect()]
    assert codes[0] == 4 and codes.count(4) == 1 and codes.count(256) == 1 and codes.count(1) == len(codes) - 2
    r = got.where("code = 4").first()
    assert (r.low_addr, r.low_port, r.high_addr, r.high_port, r.secs) == ("0A000001", 1000, "0A000002", 80, 1_700_000_000)
    assert got.agg(F.sum("length")).first()[0] == 490


def test_carried_numbers(spark):
    x, want = 99, []
    for _ in range(500):
        x = 0xFFFFDA61 * (x & 0xFFFFFFFF) + (x >> 32)
        want.append(struct.unpack("<i", struct.pack("<I", x & 0xFFFFFFFF))[0])
    df = spark.createDataFrame([(n,) for n in [*range(500), 3, None, -1]], "n long").repartition(3)
    assert all(r.v == (want[r.n] if r.n is not None and r.n >= 0 else None) for r in df.select("n", synthetic.carried(F.col("n"), 99).alias("v")).collect())
    assert synthetic.numbers(spark, 50).count() == 50


def test_late_rows_are_kept_apart(spark, tmp_path):
    """Late rows are counted and kept; what was read of closed intervals stays, also where a batch is repeated."""
    batches = [[(1, 100), (2, 3700), (3, 3500)], [(4, 7300), (5, 3590), (6, 3000), (7, None)], [(8, 200), (9, 7100), (10, 15_000)], [(11, 7250), (12, 14_500), (13, 14_999)]]
    schema = spark.createDataFrame([], "id int, ts timestamp").schema
    at, seen = str(tmp_path / "out"), []
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "id int, s long").select("id", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        for _ in range(2):  # the second run finds nothing new
            lates.apart(stream, "ts", 3600, 300, at).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        seen.append({r.id: r.interval for r in lates.closed(spark, at, schema, 3600, 300).collect()})
    assert seen == [{}, {1: 0, 3: 0, 5: 0}, {1: 0, 3: 0, 5: 0, 2: 1, 9: 1, 4: 2}, {1: 0, 3: 0, 5: 0, 2: 1, 9: 1, 4: 2}]
    found = lates.late(spark, at, schema)
    assert {r.id: r.interval for r in found.collect()} == {6: 0, 8: 0, 11: 2, 12: 4} and {r["interval"]: r["count"] for r in found.groupBy("interval").count().collect()} == {0: 2, 2: 1, 4: 1}
    assert set(seen[-1]) == {1, 2, 3, 4, 5, 9}


def test_retention(spark, tmp_path):
    """Rows arrive in three batches; only the last three hours stay, whichever batch brought them."""
    schema = "id int, ts timestamp"
    for b, hours in enumerate([(0, 1, 2), (2, 3), (5,)]):
        rows = spark.createDataFrame([(10 * b + h, h * 3600 + 60) for h in hours], "id int, s long").select("id", F.timestamp_seconds("s").alias("ts"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        live.retain(stream, "ts", 3600, 3, str(tmp_path / "kept")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = live.retained(spark, str(tmp_path / "kept"), spark.createDataFrame([], schema).schema)
    assert sorted((r.id, r.interval) for r in got.collect()) == [(13, 3), (25, 5)]


def test_written_captures_have_bounded_sizes(spark, tmp_path):
    """However much a partition holds, its captures are of about ``roll`` bytes, in order of their names."""
    rows = [(1_700_000_000_000_000 + i * 1000, bytes([i % 251]) * (i % 40)) for i in range(500)]
    df = spark.createDataFrame(rows, "ts_us long, packet binary").repartition(1).sortWithinPartitions("ts_us")
    assert captures.write(df, str(tmp_path / "out"), roll=1000) == 500
    files = sorted((tmp_path / "out").glob("*.pcap"))
    assert len(files) > 10 and max(f.stat().st_size for f in files) <= 24 + 1000 + 16 + 40
    assert [(us, p) for f in files for _, us, _, _, p in captures.packets(io.BytesIO(f.read_bytes()))] == rows
    assert sorted((r.ts_us, bytes(r.packet)) for r in captures.read(spark, str(tmp_path / "out"), glob="*.pcap").collect()) == rows
    assert captures.write(df.limit(0), str(tmp_path / "none")) == 0 and not list((tmp_path / "none").glob("*.part"))
