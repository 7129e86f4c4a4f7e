"""Secret scans through nested encodings.

A worklist unwraps URL, Unicode, base64 and compressed layers until nothing new appears. Every layer is scanned
like the text itself, and what is found is mapped back to the characters of the text that carry it.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pick

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_KEYWORD = re.compile(r"[:=]")
#: A maximal run is long enough, or no part of it is: so the least length can stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|(\\u[0-9A-Fa-f]{4})+|\\U([0-9A-Fa-f]{8})|(\\x[0-9A-Fa-f]{2})+")
_BASE64 = (re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{16,}={0,2}"))
#: Runs over line breaks, also those written \\n, with blanks around; the least length holds for all lines together.
_BLOCK64 = tuple(
    (re.compile(rf"(?:(?<![\\{a}])|(?<=\\n)|(?<=\\)(?!n))[{a}]++(?:[\x20\t]*+(?:\r\n?|\n|(?:\\r)?\\n)[\x20\t]*+[{a}]++)++={{0,2}}"), re.compile(rf"[{a}]+(?:=+\Z)?|\\r|\\n"))
    for a in ("A-Za-z0-9+/", "A-Za-z0-9_-")
)
#: No block of lines without it; quick to search.
_JOINT = re.compile(r"[\r\n\\](?<=[A-Za-z0-9+/_\x20\t-][\r\n\\])[\r\n\\]{0,3}[rn]?[\r\n\\]?n?[\x20\t]*[A-Za-z0-9+/_-]")
_MAGIC = (b"\x1f\x8b", b"x\x01", b"x\x5e", b"x\x9c", b"x\xda", b"BZh", b"\xfd7zXZ\x00")

#: Bytes that are inflated at once; windows in which inflated text is read, and by how much they overlap.
PIECE = 1 << 18
WINDOW = 1 << 20
OVERLAP = 1 << 16

Span = tuple[int, int, int]  # start, index of the kind, end


def scan(text: str) -> list[Span]:
    """The base rules over one string, sorted."""
    found = []
    if _KEYWORD.search(text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


Source = Callable[[], Iterator[bytes]]


def _tool(head: bytes):
    return lzma.LZMADecompressor() if head[:1] == b"\xfd" else bz2.BZ2Decompressor() if head[:1] == b"B" else zlib.decompressobj(47)


def _members(source: Source) -> Iterator[tuple[int, bytes]]:
    """(member, piece of what it holds) of compressed members that follow each other, and then the bytes after them as one more.

    A piece has PIECE bytes at most, whatever they are inflated from; of a cut or broken member comes what it still has.
    """
    chunks = source()
    data, member = b"", 0
    while True:
        while len(data) < 6 and (more := next(chunks, b"")):
            data = (data + more).lstrip(b"\0") if member else data + more  # members may be padded
        if not data.startswith(_MAGIC):
            if member:  # what follows the last member
                while data:
                    yield member, data
                    data = next(chunks, b"")
            return
        tool = _tool(data)
        try:
            while not tool.eof:
                if isinstance(tool, (bz2.BZ2Decompressor, lzma.LZMADecompressor)):
                    got = tool.decompress(data, PIECE)
                    data = next(chunks, b"") if tool.needs_input and not tool.eof else b""
                    done = tool.needs_input and not data
                else:
                    got = tool.decompress(data, PIECE)
                    data = tool.unconsumed_tail
                    done = not data and not got and not tool.eof and not (data := next(chunks, b""))
                if got:
                    yield member, got
                if done and not tool.eof:
                    return
        except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError):
            return
        data, member = tool.unused_data.lstrip(b"\0"), member + 1


def _holds(source: Source, since: int = 0) -> Source:
    return lambda: (piece for member, piece in _members(source) if member >= since)


def _opened(source: Source, met: set[bytes]) -> Iterator[Source]:
    """A compressed source, and those in what it holds: as one, and from each member on that starts so.

    Nothing is kept of a source but its digest; one that was met before is not opened again.
    """
    first: dict[int, bytes] = {}
    digest = hashlib.blake2b(digest_size=16)
    for member, piece in _members(source):
        if len(first.get(member, b"")) < 6:
            first[member] = first.get(member, b"") + piece[:6]
        digest.update(piece)
    if not first or digest.digest() in met:
        return
    met.add(digest.digest())
    yield source
    for member, head in first.items():
        if head.startswith(_MAGIC):
            yield from _opened(_holds(source, member), met)


def _windows(source: Source) -> Iterator[str]:
    """Texts of what a compressed source holds, as one and member by member: of WINDOW bytes at most, overlapping by OVERLAP."""
    every, own, last = _Window(), _Window(), 0
    for member, piece in _members(source):
        if member != last:
            yield from own.rest()
            own, last = _Window(), member
        yield from every.texts(piece)
        yield from own.texts(piece)
    yield from every.rest()
    if last:
        yield from own.rest()


class _Window:
    def __init__(self):
        self.held, self.new = b"", False

    def texts(self, piece: bytes) -> Iterator[str]:
        self.held, self.new = self.held + piece, True
        while len(self.held) >= WINDOW:
            yield from _text_of(self.held[:WINDOW])
            self.new = len(self.held) > WINDOW
            self.held = self.held[WINDOW - OVERLAP :]

    def rest(self) -> Iterator[str]:
        if self.new:
            yield from _text_of(self.held)


def _text_of(raw: bytes) -> Iterator[str]:
    start = 0
    while start < min(4, len(raw)) and raw[start] & 0xC0 == 0x80:  # a window may start and end inside a character
        start += 1
    for stop in range(len(raw), max(len(raw) - 4, start), -1):
        if (text := _readable(raw[start:stop])) is not None:
            yield text
            return


def _inflated(raw: bytes) -> Iterator[str]:
    """The texts in compressed bytes, also where one compressed layer lies directly in another, in windows of bounded size."""
    if raw.startswith(_MAGIC):
        for source in _opened(lambda: iter((raw,)), {hashlib.blake2b(raw, digest_size=16).digest()}):
            yield from _windows(source)


def _readable(raw: bytes) -> str | None:
    """As UTF-8 text, if it is such and has hardly a control character."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    odd = sum(1 for c in text if not (c.isprintable() or c in "\t\r\n"))
    return text if text and odd * 20 <= len(text) else None


class _Layer:
    """A string whose character i comes from the characters lo[i] to hi[i] of the document (None: from i to i + 1)."""

    def __init__(self, text: str, lo: np.ndarray | None = None, hi: np.ndarray | None = None):
        self.text, self.lo, self.hi = text, lo, hi

    def span(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.lo is None else (int(self.lo[start:end].min()), int(self.hi[start:end].max()))

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        return (np.arange(len(self.text)), np.arange(1, len(self.text) + 1)) if self.lo is None else (self.lo, self.hi)


def _characters(raw: bytes, text: str, width: int) -> tuple[list[int], list[int]]:
    """Where each character of decoded bytes starts and ends, in source characters of `width` for a byte."""
    sizes = [len(c.encode("utf-8")) for c in text]
    stops = np.cumsum(sizes) * width
    return [int(x) for x in np.concatenate(([0], stops[:-1]))], [int(x) for x in stops]


def _replaced(layer: _Layer, pattern: re.Pattern, decode) -> _Layer | None:
    """The layer with every run that can be decoded replaced; decode gives the text and where its characters lie in the run."""
    lo, hi = None, None
    pieces, los, his, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        got = decode(m[0])
        if got is None:
            continue
        if lo is None:
            lo, hi = layer.ends()
        text, starts, stops = got
        pieces += [layer.text[at : m.start()], text]
        los += [lo[at : m.start()], lo[m.start() + np.array(starts, np.int64)]]
        his += [hi[at : m.start()], hi[m.start() + np.array(stops, np.int64) - 1]]
        at = m.end()
    if lo is None:
        return None
    return _Layer("".join([*pieces, layer.text[at:]]), np.concatenate([*los, lo[at:]]), np.concatenate([*his, hi[at:]]))


def _url(run: str):
    raw = bytes.fromhex(run.replace("%", ""))
    text = _readable(raw)
    return None if text is None else (text, *_characters(raw, text, 3))


def _escape(run: str):
    if run.startswith("\\u{"):
        codes, width = [int(run[3:-1], 16)], len(run)
    else:
        width = {"u": 6, "U": 10, "x": 4}[run[1]]
        codes = [int(run[i + 2 : i + width], 16) for i in range(0, len(run), width)]
    text, starts, stops, i = [], [], [], 0
    while i < len(codes):
        n = 1
        c = codes[i]
        if 0xD800 <= c < 0xDC00 and i + 1 < len(codes) and 0xDC00 <= codes[i + 1] < 0xE000:
            c, n = 0x10000 + ((c - 0xD800) << 10) + codes[i + 1] - 0xDC00, 2
        if c > 0x10FFFF:
            return None
        text.append(chr(c))
        starts.append(i * width)
        stops.append((i + n) * width)
        i += n
    return "".join(text), starts, stops


def _base64(text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """What may be base64, without padding, and the pieces of the text that it stands in: single runs and blocks of lines."""
    seen = set()
    for pattern in _BASE64:
        for m in pattern.finditer(text):
            if (m.span(),) not in seen:
                seen.add((m.span(),))
                body = m[0].rstrip("=")
                if len(body) % 4 != 1 and not m[0].isdigit():
                    yield body, [m.span()]
    for chain, run in _BLOCK64 if _JOINT.search(text) else ():
        for m in chain.finditer(text):
            for lines in _blocks([r.span() for r in run.finditer(text, m.start(), m.end()) if r[0][0] != "\\"]):
                if tuple(lines) not in seen:
                    seen.add(tuple(lines))
                    body = "".join(text[i:j] for i, j in lines).rstrip("=")
                    if len(body) >= 16 and len(body) % 4 != 1 and not body.isdigit():
                        yield body, lines


def _blocks(lines: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """All lines; and those of one length, with and without a line of another length before them and a shorter one after."""
    yield lines
    size = [j - i for i, j in lines]
    a = 0
    while a < len(lines):
        b = a + 1
        while b < len(lines) and size[b] == size[a]:
            b += 1
        for start in {a, max(a - 1, 0)}:
            for stop in {b, min(b + 1, len(lines)) if b < len(lines) and size[b] < size[a] else b}:
                if stop - start > 1:
                    yield lines[start:stop]
        a = b


def _unwrapped(layer: _Layer) -> Iterator[_Layer]:
    text = layer.text
    if "%" in text:
        if (new := _replaced(layer, _URL, _url)) is not None:
            yield new
        for m in _URL.finditer(text):
            raw = bytes.fromhex(m[0].replace("%", ""))
            lo, hi = layer.span(m.start(), m.end())
            for inner in _inflated(raw):
                yield _Layer(inner, np.broadcast_to(lo, len(inner)), np.broadcast_to(hi, len(inner)))
    if "\\" in text and (new := _replaced(layer, _ESCAPE, _escape)) is not None:
        yield new
    for body, pieces in _base64(text):
        try:
            raw = base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4))
        except (binascii.Error, ValueError):
            continue
        for inner in _inflated(raw):
            lo, hi = layer.span(pieces[0][0], pieces[-1][1])
            yield _Layer(inner, np.broadcast_to(lo, len(inner)), np.broadcast_to(hi, len(inner)))
        if (inner := _readable(raw)) is not None:
            lo, hi = layer.ends()
            at = np.concatenate([np.arange(i, j) for i, j in pieces])
            starts, stops = _characters(raw, inner, 1)
            starts = at[np.array(starts) * 4 // 3]
            stops = at[np.minimum(-(-np.array(stops) * 4 // 3), len(at)) - 1]
            yield _Layer(inner, lo[starts], hi[stops])


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, of one whole text (null: empty); positions count code points.

    A layer that was met before is not opened again, so that texts which unwrap to each other come to an end. What
    compressed layers inflate to is read in windows: memory follows the text, not what it unpacks to. A secret longer
    than the windows' overlap is still found, since its beginning is one.
    """
    text = text or ""
    base = scan(text)
    every = set(base)
    met, open_ = {hash(text)}, [_unwrapped(_Layer(text))]
    while open_:  # the innermost layer first, so that one window of each is held
        new = next(open_[-1], None)
        if new is None:
            open_.pop()
            continue
        name = hash((new.text, int(new.lo[0]), int(new.hi[-1])))
        if name in met:
            continue
        met.add(name)
        for start, kind, end in scan(new.text):
            lo, hi = new.span(start, end)
            every.add((lo, kind, hi))
        open_.append(_unwrapped(new))
    return base, sorted(every)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    The counts and the digest are of the base spans; spans has those and what the layers add. Null and empty
    texts have none; rows that repeat an id are scanned each for itself; no rows give no rows. One pass, no shuffle;
    a text is held once with its layers.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["text"]:
                base, every = find(t)
                counts = [sum(k == i for _, k, _ in base) for i in range(3)]
                out.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
            frame = pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            frame.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield frame

    return pick(docs, doc_id="long", text="string").mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones as one, replaced by the mark; null stays null."""
    if not text:
        return text
    _, every = find(text)
    if not every:
        return text
    out, at = [], 0
    for start, _, end in every:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs, all columns, with secrets in text replaced; null stays null, and the other columns as they are."""
    replace = F.pandas_udf(lambda s: s.map(redacted, na_action="ignore"), "string", F.PandasUDFType.SCALAR)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = names[docs.columns.index("text")]
    return docs.toDF(*names).withColumn(at, replace(F.col(at).cast("string"))).toDF(*docs.columns)
