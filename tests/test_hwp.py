import random
import struct
import zlib

import pytest

from loamline.sources import files as S
from loamline.sources import hwp as H

END, FREE = 0xFFFFFFFE, 0xFFFFFFFF


def compound(streams, sector=512):
    """A compound file: streams of 4096 bytes and more in sectors, smaller ones in the mini stream; one storage level."""
    per, data, fat = sector // 4, [], []

    def put(body):
        n = len(data)
        parts = [body[i : i + sector].ljust(sector, b"\0") for i in range(0, len(body), sector)]
        data.extend(parts)
        fat.extend([*range(n + 1, n + len(parts)), END])
        return n

    mini, mini_fat, where = b"", [], {}
    for name, body in streams.items():
        if len(body) >= 4096:
            where[name] = put(body)
        else:
            n, k = len(mini_fat), max(1, -(-len(body) // 64))
            where[name] = n if body else END
            if body:
                mini += body.ljust(64 * k, b"\0")
                mini_fat += [*range(n + 1, n + k), END]
    mini_at = put(mini) if mini else END
    table = struct.pack(f"<{len(mini_fat)}I", *mini_fat)
    mini_fat_at = put(table + b"\xff" * (-len(table) % sector)) if mini_fat else END
    folders = sorted({n.split("/")[0] for n in streams if "/" in n})
    names = ["Root Entry", *folders, *streams]
    child = {i: FREE for i in range(len(names))}
    left = dict.fromkeys(range(len(names)), FREE)
    for parent, own in [(0, [*range(1, 1 + len(folders)), *(i for i, n in enumerate(names) if i > len(folders) and "/" not in n)])] + [(1 + k, [i for i, n in enumerate(names) if n.startswith(f + "/")]) for k, f in enumerate(folders)]:
        for a, b in zip(own, own[1:]):
            left[a] = b
        child[parent] = own[0] if own else FREE
    entries = b""
    for i, n in enumerate(names):
        short = n.rsplit("/", 1)[-1].encode("utf-16-le") + b"\0\0"
        kind = 5 if i == 0 else 1 if i <= len(folders) else 2
        first, size = (mini_at, len(mini)) if i == 0 else (0, 0) if kind == 1 else (where[n], len(streams[n]))
        entries += short.ljust(64, b"\0") + struct.pack("<HBBIII", len(short), kind, 1, left[i], FREE, child[i]) + b"\0" * 36 + struct.pack("<IQ", first, size)
    directory = put(entries.ljust(-(-len(entries) // sector) * sector, b"\0"))
    n_fat = 1
    while (len(data) + n_fat) > n_fat * per:
        n_fat += 1
    at = list(range(len(data), len(data) + n_fat))
    fat += [0xFFFFFFFD] * n_fat
    fat += [FREE] * (n_fat * per - len(fat))
    data += [struct.pack(f"<{per}I", *fat[i : i + per]) for i in range(0, len(fat), per)]
    head = H.MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, sector.bit_length() - 1, 6) + b"\0" * 6 + struct.pack("<IIIIIIIIII", 0, n_fat, directory, 0, 4096, mini_fat_at, 1 if mini_fat else 0, END, 0, at[0])
    head += struct.pack(f"<{len(at) - 1}I", *at[1:]) + b"\xff" * (4 * (109 - len(at)))
    return head.ljust(sector, b"\0") + b"".join(data)


def record(tag, level, body):
    size = len(body)
    return struct.pack("<I", tag | level << 10 | min(size, 0xFFF) << 20) + (struct.pack("<I", size) if size >= 0xFFF else b"") + body


def text(level, t):
    return record(66, level, b"\0" * 22) + record(H.PARA_TEXT, level + 1, t.encode("utf-16-le"))


def table(level, rows):
    out = record(71, level + 1, b" lbt") + record(H.TABLE, level + 2, struct.pack("<IHH", 0, len(rows), len(rows[0])))
    for row in rows:
        for cell in row:
            out += record(H.LIST_HEADER, level + 2, b"\0" * 8)
            out += b"".join(c if isinstance(c, bytes) else text(level + 2, c) for c in cell)
    return out


CONTROL = "\x0b" + "ab" * 3 + "\x0b"  # eight units: a control, six of its own, the control again
TAB = "\t" + "xy" * 3 + "\t"
SECTION = text(0, "첫 문단\n둘째 줄\r") + text(0, f"a{CONTROL}b{TAB}c\x18d\x1ee\r") + table(0, [[["h1"], ["h|2", "more"]], [["x"], [text(2, "in "), table(2, [[["deep"]]])]]]) + text(0, "끝 😀\r") + text(0, "\r")
WANT = "첫 문단\n둘째 줄\r\n\na" + "b\tc-d e\r\n\n| h1 | h\\|2 / more |\n| --- | --- |\n| x | in  / \\| deep \\| / \\| --- \\| |\n\n끝 😀\r"


def hwp(sections, packed=True, flags=None):
    pack = lambda b: (c := zlib.compressobj(9, zlib.DEFLATED, -15)).compress(b) + c.flush() if packed else b
    header = b"HWP Document File".ljust(32, b"\0") + struct.pack("<II", 0x05000300, int(packed) if flags is None else flags) + b"\0" * 216
    return compound({"FileHeader": header, "DocInfo": b"x" * 5000, "Empty": b"", **{f"BodyText/Section{i}": pack(s) for i, s in enumerate(sections)}})


@pytest.mark.parametrize("packed", [True, False])
def test_sections_come_back(packed):
    long = text(0, "long " * 2000)
    got = S._hwp(hwp([SECTION, long, *[text(0, f"s{i}") for i in range(2, 12)]], packed))
    assert [t.replace("\r", "") for _, t in got[:2]] == [WANT.replace("\r", ""), "long " * 2000]
    assert [i for i, _ in got] == list(range(12)) and got[11][1] == "s11"


@pytest.mark.parametrize("sector", [512, 4096])
def test_streams_of_all_sizes(sector):
    rng = random.Random(1)
    streams = {f"s{n}": rng.randbytes(n) for n in (0, 1, 63, 64, 65, 4095, 4096, 4097, 70_000, 200_000)} | {"dir/inner": b"x" * 100, "dir/big": rng.randbytes(9000)}
    f = H.CompoundFile(compound(streams, sector))
    assert {n: f.read(n) for n in f.streams} == streams


def test_damaged_files_are_refused():
    good = hwp([SECTION])
    for data, why in ((b"", "not a compound"), (good[:600], "beyond the file"), (hwp([SECTION], flags=3), "password"), (compound({"FileHeader": b"other".ljust(256, b"\0")}), "no HWP"), (compound({"a": b"b"}), "no HWP"), (hwp([]), "no sections"), (hwp([SECTION[:-3]], False), "a record is cut")):
        with pytest.raises(H.Damaged, match=why):
            S._hwp(data)
    rng = random.Random(2)
    for _ in range(400):
        data = bytearray(good)
        for _ in range(rng.randrange(1, 12)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        try:
            S._hwp(bytes(data))
        except (H.Damaged, struct.error, zlib.error, IndexError, KeyError, MemoryError, UnicodeError):
            pass


def test_reader_takes_hwp(spark, tmp_path):
    (tmp_path / "a.hwp").write_bytes(hwp([text(0, "one"), text(0, "two")]))
    (tmp_path / "b.hwp").write_bytes(hwp([SECTION])[:700])
    got = sorted((r.file_name, r.page, r.content, r.error is None) for r in S.documents(S.binary_files(spark, str(tmp_path))).collect())
    assert got == [("a.hwp", 0, "one", True), ("a.hwp", 1, "two", True), ("b.hwp", 0, None, False)]
