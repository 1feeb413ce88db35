import struct

import pytest

from packetloom.functions.dissect import dissect
from packetloom.sources import capture_files as CF
from tests.test_packets import eth, ip, udp

FRAME = eth(0x0800, ip(17, udp(1, 2)))


def classic(order="<", magic=0xA1B2C3D4, frames=2, cut=0):
    data = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for i in range(frames):
        data += struct.pack(order + "IIII", 1_700_000_000 + i, 5000, len(FRAME), len(FRAME)) + FRAME
    return data[:len(data) - cut] if cut else data


def ng(resolution=None):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        size = len(body) + 12
        return struct.pack("<II", kind, size) + body + struct.pack("<I", size)

    options = struct.pack("<HHB3xHH", 9, 1, resolution, 0, 0) if resolution is not None else b""
    ticks = 1_700_000_000 * (10 ** resolution if resolution is not None else 10 ** 6)
    return (
        block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 65535) + options)
        + block(6, struct.pack("<IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(FRAME), len(FRAME)) + FRAME)
        + block(3, struct.pack("<I", len(FRAME)) + FRAME))


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("magic,fraction", [(0xA1B2C3D4, 5000), (0xA1B23C4D, 5)])
def test_classic(order, magic, fraction):
    rows = list(CF.walk_records(classic(order, magic)))
    assert [(r[0], r[1], bytes(r[2])) for r in rows] == [
        (1_700_000_000_000_000 + fraction, 1, FRAME), (1_700_000_001_000_000 + fraction, 1, FRAME)]


def test_cut_record_is_reported():
    found = []
    with pytest.raises(ValueError, match="cut off"):
        for record in CF.walk_records(classic(frames=3, cut=5)):
            found.append(record)
    assert len(found) == 2


@pytest.mark.parametrize("resolution", [None, 9, 3])
def test_next_generation(resolution):
    first, second = CF.walk_records(ng(resolution))
    assert first[0] == 1_700_000_000_000_000 and bytes(first[2]) == FRAME and bytes(second[2]) == FRAME


def test_unknown_content():
    with pytest.raises(ValueError):
        CF.walk_records(bytes(30))


def test_folder(spark, tmp_path):
    files = {"good.pcap": classic(), "next.pcapng": ng(), "header.cap": classic(frames=0), "bad.pcap": bytes(40),
             "tiny.pcap": bytes(10), "notes.txt": b"x" * 50, "UPPER.PCAP": classic(frames=1)}
    for n, data in files.items():
        (tmp_path / n).write_bytes(data)
    frames = CF.scan_captures(spark, str(tmp_path))
    packets = dissect(frames)
    status = {r["capture_id"].rsplit("/", 1)[-1]: r for r in CF.capture_status(spark, str(tmp_path), frames, packets).collect()}
    assert set(status) == set(files)
    assert {n: r["packets"] for n, r in status.items()} == {
        "good.pcap": 2, "next.pcapng": 2, "header.cap": 0, "bad.pcap": 0, "tiny.pcap": 0, "notes.txt": 0, "UPPER.PCAP": 1}
    assert status["good.pcap"]["error"] is None
    assert status["bad.pcap"]["error"] == "not a capture file"
    assert "too small" in status["tiny.pcap"]["error"] and "unsupported" in status["notes.txt"]["error"]
    assert status["header.cap"]["error"] == "no parseable IP/ARP packets found"


def test_streamed_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.pcap").write_bytes(classic(frames=i + 1))
    stream = dissect(CF.stream_captures(spark, str(tmp_path / "in"), files_per_trigger=1))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
