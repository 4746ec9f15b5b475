"""Secret scans through nested encodings.

A worklist holds layers of text.  Every layer is scanned with the base
patterns; then each encoded stretch in it (URL escapes, Unicode and character
escapes, base64, hex, and gzip, zlib, raw deflate, bzip2 and xz inside base64 or
hex) is decoded into a new layer.  Runs that go on after a line break are joined first, and of a decoding
that is text only in part (a run glued to other characters) each stretch of
text and each archive in it is a layer.  It ends when no layer yields a new one; a digest set stops cycles, such as
archives that hold themselves.  Each layer carries a map from its characters to
spans of the original text, so findings are reported in code points of it.

Cases: null counts as empty; empty texts give no spans; a text of any length
is scanned whole; equal spans found by several layers are reported once.  A
compressed layer of more than ``max_layer`` characters (a bomb) is scanned in
overlapping windows while it is unpacked and is not decoded further; a
finding of over 65,536 characters in such a layer may be cut at a window."""

from __future__ import annotations

import base64
import binascii
import bisect
import bz2
import hashlib
import lzma
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

KINDS = ("assign", "access", "hex")


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: Fixed patterns of the base scan.
_ASSIGN = re.compile(("(?:" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""").encode())
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HINTS = (b"passw", b"secret", b"token", b"api")

_LOWER = bytes(range(256)).lower()
_HEX_MASK = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))
_B64_MASK = bytes(120 if c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_" else 32 for c in range(256))
_HEX_RUN = re.compile(rb"x{24,}")
_B64_RUN = re.compile(rb"x{16,}")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|U\+([0-9A-Fa-f]{4,6})")
_BREAK = re.compile(r"(?<=[A-Za-z0-9+/_-])\r?\n[ \t]*(?=[A-Za-z0-9+/_-])")
_CASED_RUN = re.compile(r"[0-9a-fA-F]{24,}")
#: No base pattern is shorter than 12 characters.
_STRETCH = re.compile("[^\ud800-\udfff\x00-\x08\x0e-\x1f\x7f]{12,}")
_ARCHIVE = re.compile(b"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|" + b"|".join(re.escape(bytes([a, b])) for a in range(8, 128, 16) for b in range(256) if (a << 8 | b) % 31 == 0))
WINDOW = 1 << 20
OVERLAP = 1 << 16


def scan(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns; one byte per code point."""
    found = []
    low = raw.translate(_LOWER)
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(raw) if m.end(1) - m.start(1) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    mask = raw.translate(_HEX_MASK)
    if b"x" * 24 in mask:
        found += [(m.start(), 2, m.end()) for m in _HEX_RUN.finditer(mask)]
    found.sort()
    return found


def _flat(text: str) -> bytes:
    """One byte per code point; what isn't ASCII can't be part of a match."""
    return text.encode("ascii", "replace")


class Layer:
    """A text whose pieces map to spans of the original.

    ``pieces``: (start here, original start, width here, width there); a
    character inside a piece maps in proportion: 1 to 1, 3 bytes to 4
    characters, or the whole piece for compressed data (width here 0)."""

    def __init__(self, text: str, pieces: list[tuple[int, int, int, int]]):
        self.text, self.pieces = text, pieces
        self.starts = [p[0] for p in pieces]
        self.whole = True

    def span(self, start: int, end: int) -> tuple[int, int]:
        first = self.pieces[bisect.bisect_right(self.starts, start) - 1]
        last = self.pieces[bisect.bisect_right(self.starts, end - 1) - 1]

        def edge(p, at, up):
            here, there, wide, wide_there = p
            if not wide:
                return there + (wide_there if up else 0)
            k = at - here
            return there + (-(-k * wide_there // wide) if up else k * wide_there // wide)

        return edge(first, start, False), edge(last, end, True)


def _printable(raw: bytes) -> str | None:
    """Decoded bytes count as a layer only if they are text."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    good = sum(c.isprintable() or c in "\t\n\r\x0b\x0c" for c in text)
    return text if text and good == len(text) else None


def _stretches(raw: bytes):
    """(first byte, text) of the stretches of text in decoded bytes."""
    text, at, done = raw.decode("utf-8", "surrogateescape"), 0, 0
    for m in _STRETCH.finditer(text):
        at += len(text[done : m.start()].encode("utf-8", "surrogateescape"))
        done = m.start()
        yield at, m[0]


class _Unpacker:
    """One interface to the stream decompressors, by the first bytes of the data."""

    errors = (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError)

    def __init__(self, raw: bytes, bare: bool = False):
        self.left, self.worker, self.done = raw, None, False
        if bare:
            self.worker = zlib.decompressobj(-15)
        elif raw[:2] == b"\x1f\x8b" or (len(raw) > 2 and raw[0] & 15 == 8 and (raw[0] << 8 | raw[1]) % 31 == 0):
            self.worker = zlib.decompressobj(47)
        elif raw[:3] == b"BZh":
            self.worker = bz2.BZ2Decompressor()
        elif raw[:6] == b"\xfd7zXZ\x00":
            self.worker = lzma.LZMADecompressor(memlimit=1 << 27)

    def step(self) -> bytes:
        """Some more bytes, at most WINDOW; ``done`` once there are no more."""
        part = self.worker.decompress(self.left, WINDOW)
        if isinstance(self.worker, (bz2.BZ2Decompressor, lzma.LZMADecompressor)):
            self.left = b""  # what is left is held inside
            self.done = self.worker.eof or (not part and self.worker.needs_input)
        else:
            fed, self.left = self.left, self.worker.unconsumed_tail
            self.done = self.worker.eof or not self.left or (not part and self.left == fed)
            if self.done and not self.worker.eof:
                part += self.worker.flush()
        return part


def _inflate(raw: bytes, limit: int, bare: bool = False):
    """Unpacked bytes of an archive: (bytes or None, windows for a bomb)."""
    unpacker, out, size = _Unpacker(raw, bare), [], 0
    if unpacker.worker is None:
        return None, None
    try:
        while not unpacker.done:
            out.append(unpacker.step())
            size += len(out[-1])
            if size > limit:
                return None, _windows(out, unpacker)
    except _Unpacker.errors:
        if not size:
            return None, None
    if bare and not unpacker.worker.eof:
        return None, None
    return b"".join(out), None


def _windows(out: list[bytes], unpacker: _Unpacker):
    """Overlapping windows of a stream that is too large to keep."""
    tail = b""
    for part in out:
        yield tail + part
        tail = (tail + part)[-OVERLAP:]
    out.clear()
    try:
        while not unpacker.done:
            part = unpacker.step()
            yield tail + part
            tail = (tail + part)[-OVERLAP:]
    except _Unpacker.errors:
        return


def _escapes(layer: Layer, raw: bytes, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match of pattern replaced by its decoding."""
    text, pieces, out, size, done, changed = layer.text, [], [], 0, 0, False
    for m in pattern.finditer(text):
        new = decode(m)
        if new is None or new == m[0]:
            continue
        if m.start() > done:
            out.append(text[done : m.start()])
            pieces.append((size, done, 1, 1))
            size += m.start() - done
        out.append(new)
        step = (m.end() - m.start()) // len(new) if (m.end() - m.start()) % len(new) == 0 else 0
        pieces.append((size, m.start(), 1 if step else 0, step or m.end() - m.start()))
        size += len(new)
        done, changed = m.end(), True
    if not changed:
        return None
    if done < len(text):
        out.append(text[done:])
        pieces.append((size, done, 1, 1))
    return _compose("".join(out), pieces, layer)


def _joined(layer: Layer) -> Layer | None:
    """The layer without line breaks between characters of encoded runs; only to decode."""
    text, pieces, out, size, done = layer.text, [], [], 0, 0
    for m in _BREAK.finditer(text):
        out.append(text[done : m.start()])
        pieces.append((size, done, 1, 1))
        size += m.start() - done
        done = m.end()
    if not done:
        return None
    pieces.append((size, done, 1, 1))
    made = _compose("".join(out) + text[done:], pieces, layer)
    made.whole = False
    return made if b"x" * 16 in _flat(made.text).translate(_B64_MASK) else None


def _compose(text: str, pieces: list[tuple[int, int, int, int]], under: Layer) -> Layer:
    """Pieces over ``under`` become pieces over the original text."""
    made = []
    bounds = [p[0] for p in pieces[1:]] + [len(text)]
    for (here, there, wide, wide_there), stop in zip(pieces, bounds, strict=True):
        if (wide, wide_there) == (1, 1):  # cut at the boundaries of the layer beneath
            k = bisect.bisect_right(under.starts, there) - 1
            end = there + stop - here
            while k < len(under.pieces) and under.starts[k] < end:
                h, t, w, wt = under.pieces[k]
                cut = max(there, h)
                made.append((here + cut - there, t + (cut - h) * wt // w if w else t, w, wt))
                k += 1
        else:
            n = wide_there if not wide else -(-(stop - here) * wide_there // wide)
            a, b = under.span(there, there + max(n, 1))
            exact = wide and b - a == n
            made.append((here, a, wide if exact else 0, wide_there if exact else b - a))
    return Layer(text, made)


def _unquote(m: re.Match) -> str | None:
    return _printable(bytes.fromhex(m[0].replace("%", "")))


def _unescape(m: re.Match) -> str | None:
    code = next((int(g, 10 if i == 5 else 16) for i, g in enumerate(m.groups()) if g), None)
    if code is None or code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return None
    return chr(code)


def _blobs(text: str, raw: bytes):
    """(start, end, decoded bytes, characters per byte) of base64 and hex runs."""
    mask = raw.translate(_B64_MASK)
    if b"x" * 16 not in mask:
        return
    for m in _B64_RUN.finditer(mask):
        run = text[m.start() : m.end()]
        for h in _CASED_RUN.finditer(run):
            for skip in range(1 if len(h[0]) == len(run) and len(run) % 2 == 0 else 2):
                body = h[0][skip:]
                body = body[: len(body) & ~1]
                yield m.start() + h.start() + skip, m.start() + h.start() + skip + len(body), bytes.fromhex(body), (1, 2)
        # A run may touch other word characters on its left: all four phases.
        for skip in range(4):
            body = run[skip:].replace("-", "+").replace("_", "/")
            body = body[: len(body) - (len(body) % 4 == 1)]
            if len(body) < 12:
                break
            try:
                yield m.start() + skip, m.start() + skip + len(body), base64.b64decode(body + "=" * (-len(body) % 4)), (3, 4)
            except (binascii.Error, ValueError):
                continue


def find_secrets(text: str, max_layer: int = 1 << 26) -> tuple[list, list]:
    """Base spans and all spans of a text: sorted (start, kind, end) lists."""
    raw = _flat(text)
    base = scan(raw)
    has = (_BREAK.search(text) is not None, "%" in text, "\\" in text or "&#" in text or "U+" in text, b"x" * 16 in raw.translate(_B64_MASK))
    if not any(has):
        return base, base
    every, seen = set(base), {hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()}
    work = [Layer(text, [(0, 0, 1, 1)])]
    while work:
        layer = work.pop()
        raw = _flat(layer.text)
        if layer.text is not text and layer.whole:
            for start, kind, end in scan(raw):
                a, b = layer.span(start, end)
                every.add((a, kind, b))
        fresh: list[Layer] = []
        if layer.whole:
            fresh.append(_joined(layer))
        if layer.whole and "%" in layer.text:
            fresh.append(_escapes(layer, raw, _URL, _unquote))
        if layer.whole and ("\\" in layer.text or "&#" in layer.text or "U+" in layer.text):
            fresh.append(_escapes(layer, raw, _ESCAPE, _unescape))
        for start, end, blob, (wide, wide_there) in _blobs(layer.text, raw):
            inner, windows = _inflate(blob, max_layer)
            if windows is not None:
                a, b = layer.span(start, end)
                every.update((a, kind, b) for part in windows for _, kind, _ in scan(part))
                continue
            if inner is not None:
                new = _printable(inner) or inner.decode("latin-1")
                fresh.append(_compose(new, [(0, start, 0, end - start)], layer))
            elif (new := _printable(blob)) is not None:
                same = len(new) == len(blob)
                fresh.append(_compose(new, [(0, start, wide if same else 0, wide_there if same else end - start)], layer))
            else:
                place = lambda k: start + k // wide * wide_there  # noqa: B023, E731
                for at, new in _stretches(blob):
                    same, n = new.isascii(), len(new.encode())
                    piece = (-(at % wide), place(at), wide, wide_there) if same else (0, place(at), 0, min(place(at + n + wide - 1), end) - place(at))
                    fresh.append(_compose(new, [piece], layer))
                inner, _ = _inflate(blob, max_layer, bare=True)  # no first bytes tell raw deflate: only whole streams of text count
                if inner and len(inner) >= 12 and (new := _printable(inner)):
                    fresh.append(_compose(new, [(0, start, 0, end - start)], layer))
                for m in _ARCHIVE.finditer(blob, 1):
                    inner, windows = _inflate(blob[m.start() :], max_layer)
                    there = place(m.start())
                    if windows is not None:
                        a, b = layer.span(there, end)
                        every.update((a, kind, b) for part in windows for _, kind, _ in scan(part))
                    elif inner and len(inner) >= 12:
                        fresh.append(_compose(_printable(inner) or inner.decode("latin-1"), [(0, there, 0, end - there)], layer))
        for new in fresh:
            if new is not None and new.text and (key := hashlib.sha256(new.text.encode("utf-8", "surrogatepass")).digest() + b"%d %d" % (new.pieces[0][1], new.whole)) not in seen:
                seen.add(key)
                work.append(new)
    return base, sorted(every)


def _say(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), max_layer: int = 1 << 26) -> DataFrame:
    """Columns ``keep`` with the base spans and all spans of each text."""
    small_batches(docs.sparkSession)
    kept = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text")

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for text in batch.column("text"):
                base, every = find_secrets(text.as_py() or "", max_layer)
                for k in range(3):
                    out[k].append(sum(s[1] == k for s in base))
                said = _say(base)
                out[3].append(said)
                out[4].append(said if every is base else _say(every))
                out[5].append(len(every))
            arrays = [batch.column(c) for c in keep] + [pa.array(out[k], pa.int64()) for k in range(3)] + [pa.array(out[3], pa.string()), pa.array(out[4], pa.string()), pa.array(out[5], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "n_assign", "n_access", "n_hex", "base_spans", "spans", "n_spans"])

    return kept.mapInArrow(run, schema + ", n_assign long, n_access long, n_hex long, base_spans string, spans string, n_spans long")


def redact(text: str, mask: str = "*") -> str:
    """The text with every found span masked."""
    _, spans = find_secrets(text)
    chars = list(text)
    for a, _, b in spans:
        chars[a:b] = mask * (b - a)
    return "".join(chars)


def op5_secret_scans(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan_secrets(docs)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_spans")
