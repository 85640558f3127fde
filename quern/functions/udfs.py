"""Functions that Spark's expressions can't say, as Arrow-batched Python functions."""

from __future__ import annotations

import json
import struct
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# types as objects: names of types could be read only once a session stands
TEXTS, NUMBERS, BAG = T.ArrayType(T.StringType()), T.ArrayType(T.DoubleType()), T.MapType(T.StringType(), T.StringType())


def parse_path(s: str) -> list[str]:
    """Elements part at points; quotes around an element are doubled within."""
    out, i, n = [], 0, len(s)
    while i <= n:
        if i < n and s[i] == '"':
            j, part = i + 1, []
            while j < n:
                if s[j] == '"':
                    if s[j + 1 : j + 2] == '"':
                        part.append('"')
                        j += 2
                        continue
                    break
                part.append(s[j])
                j += 1
            out.append("".join(part))
            i = j + 2
        else:
            j = s.find(".", i)
            j = n if j < 0 else j
            out.append(s[i:j])
            i = j + 1
    return out


@pandas_udf(TEXTS)
def _path_parts(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else parse_path(x))


def path_parts(c: Column) -> Column:
    return _path_parts(c)


def _spelled(v: object) -> str:
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def flatten_json(v: object, arrays: str, prefix: str = "") -> dict[str, str | None]:
    out: dict[str, str | None] = {}
    at = (lambda k: f"{prefix}.{k}" if prefix else str(k))
    if isinstance(v, dict):
        for k, x in v.items():
            out |= flatten_json(x, arrays, at(k))
    elif isinstance(v, list):
        for i, x in enumerate(v):
            if arrays == "encode":
                out |= {at(i): _spelled(x)} if isinstance(x, (dict, list)) else {at(_spelled(x)): "1"}
            else:
                out |= flatten_json(x, arrays, at(i))
    else:
        out[prefix] = None if v is None else _spelled(int(v) if isinstance(v, bool) else v)
    return out


@pandas_udf(BAG)
def flat_json(s: pd.Series, arrays: pd.Series, skip: pd.Series) -> pd.Series:
    def one(x, how, ignore):
        if x is None:
            return None
        try:
            return flatten_json(json.loads(x), how)
        except ValueError:
            if ignore:
                return None
            raise

    return pd.Series([one(*z) for z in zip(s, arrays, skip, strict=True)])


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links: list[str] = []
        self.text: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.skip:
            self.skip -= 1

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def read_page(s: str | None) -> _Page | None:
    if s is None:
        return None
    p = _Page()
    p.feed(s)
    p.close()
    return p


@pandas_udf(TEXTS)
def links(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else read_page(x).links)


@pandas_udf(T.StringType())
def page_text(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else " ".join(" ".join(read_page(x).text).split()))


# How common formats begin.
MAGIC = (
    (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"%PDF", "application/pdf"), (b"PK\x03\x04", "application/zip"), (b"\x1f\x8b", "application/gzip"),
    (b"BM", "image/bmp"), (b"RIFF", "audio/x-wav"), (b"\x7fELF", "application/x-executable"), (b"<?xml", "text/xml"), (b"<!DOCTYPE html", "text/html"), (b"<html", "text/html"),
)


def mime_of(b: bytes) -> str:
    for magic, kind in MAGIC:
        if b.startswith(magic):
            return kind
    try:
        b.decode()
    except UnicodeDecodeError:
        return "application/octet-stream"
    return "text/plain"


@pandas_udf(T.StringType())
def mime(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else mime_of(bytes(x)))


# Numbers of EXIF tags.
EXIF_TAGS = {0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x011A: "XResolution", 0x011B: "YResolution", 0x0131: "Software", 0x0132: "DateTime", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "ISOSpeedRatings", 0x9003: "DateTimeOriginal", 0x920A: "FocalLength", 0xA002: "ImageWidth", 0xA003: "ImageHeight"}


def read_exif(b: bytes) -> dict[str, str]:
    at = b.find(b"Exif\x00\x00")
    if at < 0:
        return {}
    tiff = b[at + 6 :]
    order = "<" if tiff[:2] == b"II" else ">"
    out: dict[str, str] = {}

    def walk(start: int) -> None:
        n = struct.unpack_from(order + "H", tiff, start)[0]
        for i in range(n):
            tag, kind, count, value = struct.unpack_from(order + "HHII", tiff, start + 2 + 12 * i)
            place = start + 2 + 12 * i + 8
            if tag == 0x8769:
                walk(value)
            elif tag in EXIF_TAGS:
                if kind == 2:
                    raw = tiff[value : value + count] if count > 4 else tiff[place : place + count]
                    out[EXIF_TAGS[tag]] = raw.rstrip(b"\x00").decode("latin-1")
                elif kind == 3:
                    out[EXIF_TAGS[tag]] = str(struct.unpack_from(order + "H", tiff, place)[0])
                elif kind == 4:
                    out[EXIF_TAGS[tag]] = str(value)
                elif kind == 5:
                    a, d = struct.unpack_from(order + "II", tiff, value)
                    out[EXIF_TAGS[tag]] = str(a / d if d else 0)

    try:
        walk(struct.unpack_from(order + "I", tiff, 4)[0])
    except struct.error:
        pass
    return out


@pandas_udf(BAG)
def exif(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else read_exif(bytes(x)))


@pandas_udf(T.StructType([T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())]))
def fetch(s: pd.Series) -> pd.DataFrame:
    import urllib.request

    def one(url):
        if url is None:
            return None, None
        try:
            with urllib.request.urlopen(url, timeout=30) as r:
                return r.read(), None
        except Exception as why:  # what fails is the answer
            return None, str(why)

    return pd.DataFrame([one(u) for u in s], columns=["content", "error"])


@pandas_udf(NUMBERS)
def fft(x: pd.Series, direction: pd.Series, kind: pd.Series) -> pd.Series:
    """Real transforms are packed: the constant and the highest frequency share the first pair."""

    def one(v, way, what):
        if v is None:
            return None
        v = np.asarray(v, float)
        if len(v) % 32:
            raise ValueError("the length must be a multiple of 32")
        if what == "complex":
            z = v[0::2] + 1j * v[1::2]
            z = np.fft.fft(z) if way == "forward" else np.fft.ifft(z) * len(z)
            return np.c_[z.real, z.imag].ravel()
        if way == "forward":
            z = np.fft.rfft(v)
            out = np.c_[z.real, z.imag][:-1]
            out[0, 1] = z[-1].real
            return out.ravel()
        p = v.reshape(-1, 2)
        z = np.r_[p[0, 0], p[1:, 0] + 1j * p[1:, 1], p[0, 1]]
        return np.fft.irfft(z, len(v)) * len(v)

    return pd.Series([one(*z) for z in zip(x, direction, kind, strict=True)])


def _in_ring(ring: list, x: float, y: float) -> bool:
    inside = False
    for (x1, y1, *_), (x2, y2, *_) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def shape_contains(shape: dict, lat: float, lon: float) -> bool:
    shape = shape.get("geometry", shape)
    polygons = [shape["coordinates"]] if shape["type"] == "Polygon" else shape["coordinates"] if shape["type"] == "MultiPolygon" else None
    if polygons is None:
        raise ValueError(f"no polygon: {shape['type']}")
    return any(_in_ring(p[0], lon, lat) and not any(_in_ring(h, lon, lat) for h in p[1:]) for p in polygons)


@pandas_udf(T.BooleanType())
def contains_point(shape: pd.Series, lat: pd.Series, lon: pd.Series) -> pd.Series:
    seen: dict[str, dict] = {}

    def one(s, a, b):
        if s is None or pd.isna(a) or pd.isna(b):
            return None
        if s not in seen:
            seen[s] = json.loads(s)
        return shape_contains(seen[s], a, b)

    return pd.Series([one(*z) for z in zip(shape, lat, lon, strict=True)], dtype=object)

