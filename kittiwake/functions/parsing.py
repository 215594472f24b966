"""Small text formats read on the driver."""

from __future__ import annotations

import configparser


def parse_ini(text: str) -> dict[str, dict[str, str]]:
    """Sections of name = value lines; lines before any section are section ''. The last of equal names counts."""
    p = configparser.ConfigParser(strict=False, interpolation=None, delimiters=("=",), comment_prefixes=("#", ";"), allow_no_value=True)
    p.optionxform = str
    p.read_string("[\0]\n" + text)
    out = {("" if s == "\0" else s): {k: v or "" for k, v in p.items(s)} for s in p.sections()}
    return {s: v for s, v in out.items() if s or v}


def parse_serialized(data: bytes | str):
    """A value in PHP's serialize format: null, booleans, numbers, strings, arrays (as dicts) and objects (as dicts with
    the class under ``__class__``)."""
    raw = data.encode() if isinstance(data, str) else data
    value, end = _serialized(raw, 0)
    if end != len(raw):
        raise ValueError(f"text after the value at {end}")
    return value


def _until(raw: bytes, at: int, mark: bytes) -> tuple[str, int]:
    end = raw.index(mark, at)
    return raw[at:end].decode(), end + len(mark)


def _serialized(raw: bytes, at: int):
    kind = raw[at : at + 2]
    if kind == b"N;":
        return None, at + 2
    if kind in (b"b:", b"i:", b"d:"):
        text, end = _until(raw, at + 2, b";")
        return (text == "1" if kind == b"b:" else int(text) if kind == b"i:" else float(text)), end
    if kind == b"s:":
        n, start = _until(raw, at + 2, b":")
        stop = start + 1 + int(n)
        if raw[start : start + 1] != b'"' or raw[stop : stop + 2] != b'";':
            raise ValueError(f"bad string at {at}")
        return raw[start + 1 : stop].decode(), stop + 2
    if kind in (b"a:", b"O:"):
        out: dict = {}
        pos = at + 2
        if kind == b"O:":
            n, pos = _until(raw, pos, b":")
            out["__class__"] = raw[pos + 1 : pos + 1 + int(n)].decode()
            pos += int(n) + 3
        count, pos = _until(raw, pos, b":")
        pos += 1
        for _ in range(int(count)):
            k, pos = _serialized(raw, pos)
            out[k], pos = _serialized(raw, pos)
        return out, pos + 1
    raise ValueError(f"bad value at {at}")
