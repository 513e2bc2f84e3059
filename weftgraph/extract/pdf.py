"""Text of PDF pages, for files whose fonts use plain encodings; no library is needed."""

from __future__ import annotations

import re
import zlib

OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
SHOWN = re.compile(rb"(\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>)|\b(T[dDm*])(?![A-Za-z])|(?<=\s)(T\*)|(')")
ESCAPES = {b"n": b"\n", b"r": b"\n", b"t": b" ", b"b": b"", b"f": b""}
MOST_STREAM = 1 << 26


def _inflated(body: bytes) -> bytes:
    found = STREAM.search(body)
    if not found:
        return b""
    data = found[1]
    if b"/FlateDecode" in body[: found.start()]:
        try:
            data = zlib.decompressobj().decompress(data, MOST_STREAM)
        except zlib.error:
            return b""
    return data


def _objects(data: bytes) -> dict[int, bytes]:
    found = {int(m[1]): m[2] for m in OBJECT.finditer(data)}
    for body in list(found.values()):
        if b"/ObjStm" in body:
            count, first = re.search(rb"/N\s+(\d+)", body), re.search(rb"/First\s+(\d+)", body)
            if count and first:
                plain, begin = _inflated(body), int(first[1])
                places = [int(x) for x in plain[:begin].split()[: 2 * int(count[1])]]
                starts = places[1::2] + [len(plain) - begin]
                for number, a, b in zip(places[::2], starts, starts[1:], strict=False):
                    found.setdefault(number, plain[begin + a : begin + b])
    return found


def _string(raw: bytes) -> str:
    if raw.startswith(b"<"):
        digits = re.sub(rb"\s", b"", raw[1:-1])
        value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        return value.decode("utf-16-be", "replace") if value.startswith(b"\xfe\xff") else value.decode("latin-1")
    out = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m[1], 8) & 255]), raw[1:-1])
    return re.sub(rb"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), out, flags=re.S).decode("latin-1")


def _shown(content: bytes) -> str:
    out: list[str] = []
    for block in re.findall(rb"\bBT\b(.*?)\bET\b", content, re.S):
        for m in SHOWN.finditer(block):
            out.append(_string(m[1]) if m[1] else "\n")
        out.append("\n")
    text = "".join(c for c in "".join(out) if c.isprintable() or c in "\n\t")
    return re.sub(r"[ \t]*\n\s*", "\n", text).strip()


def pages(data: bytes) -> list[str]:
    """The text of each page in order; an empty list where no page can be read."""
    found = _objects(data)
    refs = lambda body, key: [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", (re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body) or [b""])[0])]
    order: list[int] = []
    seen: set[int] = set()

    def walk(number: int) -> None:
        body = found.get(number, b"")
        if number in seen:
            return
        seen.add(number)
        if re.search(rb"/Type\s*/Pages\b", body):
            for kid in refs(body, b"Kids"):
                walk(kid)
        elif re.search(rb"/Type\s*/Page\b", body):
            order.append(number)

    for number, body in found.items():
        if re.search(rb"/Type\s*/Pages\b", body) and b"/Parent" not in body:
            walk(number)
    return [_shown(b"\n".join(_inflated(found.get(c, b"")) for c in refs(found[n], b"Contents"))) for n in order]
