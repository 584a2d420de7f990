"""Media columns: GIF. LZW streams, palettes, disposal and transparency, timed frames, colour histograms.

The width of every code is known from its number since the last clear code, so the codes of a
run are cut out of the stream together. A table entry is the string of an earlier code and one
more sample, that is a pointer to that code; lengths, first samples and then all samples follow
from the pointers, for all codes of a run at once.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, spread, texts_of

MAX_CODES = 4096


_BITS = np.array([i.bit_length() for i in range(MAX_CODES)])


def _bits_of(entries: np.ndarray, least: int) -> np.ndarray:
    return np.maximum(least, _BITS[entries])


def _widths(first: int, n: int, start_bits: int) -> np.ndarray:
    """Bits of the codes first .. first + n - 1 since a clear code."""
    clear = 1 << (start_bits - 1)
    entries = np.minimum(clear + 2 + np.maximum(np.arange(first, first + n) - 1, 0), MAX_CODES - 1)
    return _bits_of(entries, start_bits)


def lzw_codes(data: bytes, min_bits: int = 8) -> list[int]:
    """Greedy longest matches; a clear code at the start and whenever the table is full. The table is a tree:
    the node of a string has its code at -1 and the nodes of longer strings under their next sample."""
    clear = 1 << min_bits
    codes = [clear]
    if not data:
        return [*codes, clear + 1]
    out, nxt = codes.append, clear + 2
    roots = [{-1: i} for i in range(clear)]
    node = roots[data[0]]
    for c in data[1:]:
        if c in node:
            node = node[c]
            continue
        out(node[-1])
        if nxt < MAX_CODES:
            node[c] = {-1: nxt}
            nxt += 1
        else:
            out(clear)
            roots = [{-1: i} for i in range(clear)]
            nxt = clear + 2
        node = roots[c]
    return [*codes, node[-1], clear + 1]


def lzw_encode(data: bytes, min_bits: int = 8) -> bytes:
    codes = np.array(lzw_codes(data, min_bits), np.int64)
    clear = 1 << min_bits
    at = np.flatnonzero(codes == clear)
    since = np.arange(len(codes)) - np.repeat(at, np.diff(np.append(at, len(codes)))) - 1
    # a clear code has the width of the code it stands in for; the first one the starting width
    since[at[1:]] = np.diff(at) - 1
    since[0] = 0
    entries = np.minimum(clear + 2 + np.maximum(since - 1, 0), MAX_CODES - 1)
    width = _bits_of(entries, min_bits + 1)
    bits = np.unpackbits(codes.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < width[:, None]], bitorder="little").tobytes()


def _strings(codes: np.ndarray, clear: int) -> np.ndarray:
    """The samples of one run's codes (no clear, no end code in it)."""
    n = len(codes)
    parent = codes - (clear + 2)
    literal = codes < clear
    if (parent[~literal] >= np.flatnonzero(~literal)).any() or (parent[~literal] < 0).any():
        raise ValueError("a code without an entry")
    jump = np.where(literal, np.arange(n), parent)
    depth = (~literal).astype(np.int64)
    while True:
        step = depth[jump]
        if not step.any():
            break
        depth = depth + step
        jump = jump[jump]
    first = codes[jump].astype(np.uint8)
    ends = np.cumsum(depth + 1)
    out = np.empty(int(ends[-1]), np.uint8)
    out[ends - depth - 1] = first
    cur = np.flatnonzero(~literal)
    at, left = ends[cur] - 1, depth[cur]
    while len(cur):
        up = parent[cur]
        out[at] = first[up + 1]
        more = left > 1
        cur, at, left = up[more], at[more] - 1, left[more] - 1
    return out


def lzw_decode(data: bytes, min_bits: int, limit: int) -> np.ndarray:
    """At most `limit` samples; clear codes may stand anywhere, a full table may stay in use."""
    clear, start_bits = 1 << min_bits, min_bits + 1
    buf = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.int64)
    total, pos, out, have = len(data) * 8, 0, [], 0
    while pos + start_bits <= total and have < limit:
        codes, guess = np.zeros(0, np.int64), MAX_CODES
        ended = False
        while not ended:
            width = _widths(0, guess, start_bits)
            off = pos + np.cumsum(width) - width
            fit = int(np.searchsorted(off + width, total, side="right"))
            off, w = off[:fit], width[:fit]
            byte = off >> 3
            raw = (buf[byte] | buf[byte + 1] << 8 | buf[byte + 2] << 16) >> (off & 7) & ((1 << w) - 1)
            stop = np.flatnonzero((raw == clear) | (raw == clear + 1))
            if len(stop) or fit < guess:
                ended = True
                n = int(stop[0]) if len(stop) else fit
                codes = raw[:n]
                over = not len(stop) or raw[n] == clear + 1
                pos = int(off[n] + w[n]) if len(stop) else total
            else:
                guess *= 4
        if len(codes):
            own = _strings(codes, clear)
            out.append(own)
            have += len(own)
        if over:
            break
    got = np.concatenate(out) if out else np.zeros(0, np.uint8)
    return got[:limit]


@dataclass
class Frame:
    indices: np.ndarray  # height x width
    left: int = 0
    top: int = 0
    delay_cs: int = 0
    disposal: int = 0  # 0, 1: stays; 2: to background; 3: to what was there before
    transparent: int | None = None
    palette: np.ndarray | None = None
    interlaced: bool = False


@dataclass
class Gif:
    width: int
    height: int
    frames: list[Frame] = field(default_factory=list)
    palette: np.ndarray | None = None
    background: int = 0
    loops: int | None = None


def _interlaced_rows(h: int) -> np.ndarray:
    return np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def _palette_bits(palette: np.ndarray) -> int:
    return max(1, int(len(palette) - 1).bit_length())


def _palette_bytes(palette: np.ndarray) -> bytes:
    full = np.zeros((1 << _palette_bits(palette), 3), np.uint8)
    full[: len(palette)] = palette
    return full.tobytes()


def write_gif(gif: Gif) -> bytes:
    out = [b"GIF89a", struct.pack("<HHBBB", gif.width, gif.height, (0x80 | (_palette_bits(gif.palette) - 1) if gif.palette is not None else 0) | 0x70, gif.background, 0)]
    if gif.palette is not None:
        out.append(_palette_bytes(gif.palette))
    if gif.loops is not None:
        out.append(b"!\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", gif.loops) + b"\0")
    for f in gif.frames:
        h, w = f.indices.shape
        out.append(b"!\xf9\x04" + struct.pack("<BHBB", f.disposal << 2 | (f.transparent is not None), f.delay_cs, f.transparent or 0, 0))
        out.append(b"," + struct.pack("<HHHHB", f.left, f.top, w, h, (0x80 | (_palette_bits(f.palette) - 1) if f.palette is not None else 0) | 0x40 * f.interlaced))
        if f.palette is not None:
            out.append(_palette_bytes(f.palette))
        own = f.palette if f.palette is not None else gif.palette
        bits = max(2, _palette_bits(own) if own is not None else 8)
        rows = f.indices[_interlaced_rows(h)] if f.interlaced else f.indices
        out.append(bytes([bits]) + _blocks(lzw_encode(np.ascontiguousarray(rows, np.uint8).tobytes(), bits)))
    return b"".join(out) + b";"


#: Pixels of a canvas or frame at most: a damaged header names sizes that no picture has.
MAX_PIXELS = 1 << 26


def read_gif(data: bytes) -> Gif:
    """Raises ValueError for bytes that are no whole GIF: another signature, an unknown block, an end within a block or
    within a frame's codes, sizes beyond MAX_PIXELS. A missing trailer alone is no damage."""
    try:
        return _read(bytes(data))
    except (struct.error, IndexError) as e:
        raise ValueError("the GIF is cut off") from e


def _read(data: bytes) -> Gif:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    w, h, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    if w * h > MAX_PIXELS:
        raise ValueError(f"{w} x {h} pixels")
    gif, at = Gif(w, h, background=background), 13

    def palette(flags: int, at: int):
        n = 2 << (flags & 7)
        if at + n * 3 > len(data):
            raise ValueError("the GIF is cut off")
        return np.frombuffer(data, np.uint8, n * 3, at).reshape(n, 3), at + n * 3

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
            if at > len(data):
                raise ValueError("the GIF is cut off")
        return b"".join(parts), at + 1

    if flags & 0x80:
        gif.palette, at = palette(flags, at)
    control = (0, 0, None)
    while at < len(data) and data[at] != 0x3B:
        kind, at = data[at], at + 1
        if kind == 0x21:
            label = data[at]
            body, at = blocks(at + 1)
            if label == 0xF9 and len(body) >= 4:
                f, delay, t = struct.unpack_from("<BHB", body)
                control = (f >> 2 & 7, delay, t if f & 1 else None)
            elif label == 0xFF and body.startswith(b"NETSCAPE2.0\x01"):
                gif.loops = struct.unpack_from("<H", body, 12)[0]
        elif kind == 0x2C:
            left, top, fw, fh, flags = struct.unpack_from("<HHHHB", data, at)
            at += 9
            if fw * fh > MAX_PIXELS:
                raise ValueError(f"{fw} x {fh} pixels")
            own = None
            if flags & 0x80:
                own, at = palette(flags, at)
            bits = data[at]
            if not 1 < bits < 9:
                raise ValueError(f"codes of {bits} bits")
            body, at = blocks(at + 1)
            got = lzw_decode(body, bits, fw * fh)
            if len(got) < fw * fh:
                raise ValueError("a frame's codes are cut off")
            rows = got.reshape(fh, fw)
            if flags & 0x40:
                straight = np.empty_like(rows)
                straight[_interlaced_rows(fh)] = rows
                rows = straight
            gif.frames.append(Frame(rows, left, top, control[1], control[0], control[2], own, bool(flags & 0x40)))
            control = (0, 0, None)
        else:
            raise ValueError(f"unknown block {kind:#x}")
    if at >= len(data) and not gif.frames:
        raise ValueError("the GIF is cut off")
    return gif


def frames_shown(gif: Gif):
    """(time in ms, RGBA canvas) of each frame as a viewer shows it. The canvas starts transparent, and so does
    what a frame of disposal 2 leaves; canvases are new arrays."""
    canvas, at = np.zeros((gif.height, gif.width, 4), np.uint8), 0
    for f in gif.frames:
        h, w = f.indices.shape
        area = (slice(f.top, min(f.top + h, gif.height)), slice(f.left, min(f.left + w, gif.width)))
        before = canvas.copy() if f.disposal == 3 else None
        palette = f.palette if f.palette is not None else gif.palette if gif.palette is not None else np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)
        full = np.zeros((256, 4), np.uint8)
        full[: len(palette), :3] = palette
        full[:, 3] = 255
        shown = f.indices[: area[0].stop - area[0].start, : area[1].stop - area[1].start]
        colours = full.view("<u4")[:, 0][shown].view(np.uint8).reshape(*shown.shape, 4)  # the four bytes of a colour at once
        if f.transparent is None:
            canvas[area] = colours
        else:
            seen = shown != f.transparent
            canvas[area][seen] = colours[seen]
        yield at, canvas.copy()
        at += f.delay_cs * 10
        if f.disposal == 2:
            canvas[area] = 0
        elif f.disposal == 3:
            canvas = before


def histogram(rgba: np.ndarray, bins: int = 4) -> np.ndarray:
    """Counts of visible pixels by red, green and blue, bins each: bins ** 3 numbers."""
    pixels = rgba.reshape(-1, 4)
    level = np.arange(256) * bins >> 8
    seen = pixels[pixels[:, 3] > 0] if not pixels[:, 3].all() else pixels
    return np.bincount((level * bins * bins)[seen[:, 0]] + (level * bins)[seen[:, 1]] + level[seen[:, 2]], minlength=bins**3)


#: Colour i stands for sample i: red is the sample itself, green falls, blue turns seven times.
SAMPLE_PALETTE = np.stack([np.arange(256), 255 - np.arange(256), np.arange(256) * 7 % 256], 1).astype(np.uint8)


def samples_to_gif(payload: bytes, width: int = 192, rows: int = 64, delay_cs: int = 10) -> bytes:
    """8-bit samples as frames of up to `rows` rows; disposals take turns, as every frame covers what it needs."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, width)
    frames = [Frame(pixels[i : i + rows], delay_cs=delay_cs, disposal=(1, 2, 3)[i // rows % 3]) for i in range(0, len(pixels), rows)]
    return write_gif(Gif(width, min(rows, len(pixels)), frames, SAMPLE_PALETTE, loops=0))


def gif_to_samples(media: bytes) -> tuple[bytes, list[dict]]:
    """The samples read from the shown frames' colours, and a row of values for each frame."""
    gif = read_gif(media)
    parts, rows = [], []
    for f, (at, canvas) in zip(gif.frames, frames_shown(gif)):
        h, w = f.indices.shape
        parts.append(canvas[f.top : f.top + h, f.left : f.left + w, 0].tobytes())
        rows.append({"time_ms": at, "delay_ms": f.delay_cs * 10, "disposal": f.disposal, "width": w, "height": h, "histogram": histogram(canvas).tolist()})
    return b"".join(parts), rows


def padded(data: bytes, unit: int = 192) -> bytes:
    return data + b" " * (-len(data) % unit or (0 if data else unit))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, media (GIF): the text's UTF-8 bytes padded with spaces to whole rows of
    192 samples. Null text counts as empty; equal texts give equal media; one row per input row."""

    def run(batches):
        for b in batches:
            data = [t.encode() for t in b["text"]]
            whole = [padded(d) for d in data]
            yield {"doc_id": b["doc_id"], "n_bytes": list(map(len, data)), "payload_bytes": list(map(len, whole)), "media": [samples_to_gif(p) for p in whole]}

    return map_rows(spread(texts_of(docs, id_col, text_col)), run, "doc_id long, n_bytes long, payload_bytes long, media binary", rows=64)


def media_frames(media: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep and: frames, an array of (time_ms, delay_ms, disposal, width, height, histogram), and error.

    Null media has null frames and no error; media that is no whole GIF has null frames and says in error why, and never
    fails the others. One row per input row; an empty table gives an empty result."""
    names = list(keep)

    def run(batches):
        for b in batches:
            out = {n: b[n] for n in names} | {"frames": [], "error": []}
            for m in b["media"]:
                frames = error = None
                try:
                    frames = None if m is None else gif_to_samples(m)[1]
                except ValueError as e:
                    error = str(e)
                out["frames"].append(frames)
                out["error"].append(error)
            yield out

    schema = ", ".join(f"{n} {media.schema[n].dataType.simpleString()}" for n in names)
    return map_rows(media.select(*names, F.col(media_col).alias("media")), run, f"{schema}, frames array<struct<time_ms:long,delay_ms:long,disposal:int,width:int,height:int,histogram:array<long>>>, error string", rows=64)


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as a GIF, read the stored bytes back, and describe both: a row per input row, equal for equal texts.
    Null text counts as empty (one row of spaces); texts of any length are stored whole; an empty table gives an empty result."""

    def run(batches):
        for b in batches:
            cols = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_ms")
            out = {"doc_id": b["doc_id"]} | {c: [] for c in cols}
            for n, media in zip(b["n_bytes"], b["media"]):
                payload, frames = gif_to_samples(media)
                total = np.sum([f["histogram"] for f in frames], 0)
                top = np.argsort(-total, kind="stable")[:4]
                length = sum(f["delay_ms"] for f in frames)
                feature = f"frames={len(frames)};ms={length};px={int(total.sum())};top=" + ",".join(f"{i}:{total[i]}" for i in top.tolist())
                for c, v in zip(cols, (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(frames), length)):
                    out[c].append(v)
            yield out

    return map_rows(text_media(docs, id_col, text_col).select("doc_id", "n_bytes", "media"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_ms long", rows=64)
