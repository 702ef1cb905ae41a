"""TIFF in media columns: one row per page, and an encoder for tests and lossless storage.

The reader walks the chain of image directories of a classic or big TIFF of either byte order,
decodes strips or tiles that are stored, PackBits, LZW or deflate, undoes the horizontal and
the floating-point predictor, and crops and interleaves what it gets into rows of samples.

``decode_pages`` works on a binary column of any DataFrame. A null or empty value, and a file
that is broken or uses a compression not named above, gives one row with ``page`` null and the
reason in ``error``; damaged later pages keep the earlier ones. Whatever bytes a value has, it gives rows, not a failure. Repeated rows give repeated
pages, further columns pass through, an empty table gives an empty result. Memory is bounded by
one file's pages at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of the TIFF 6.0 specification and its BigTIFF extension.
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CODECS = {"none": NONE, "lzw": LZW, "deflate": DEFLATE, "packbits": PACKBITS}


#: Bytes that one of any of the codecs stands for at most: LZW's longest string by its longest code, and eight samples a byte.
MOST_EXPANDED = 4096 * 8


class TiffError(ValueError):
    pass


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i > 1:
            out += bytes((257 - (j - i), data[i]))
        else:
            while j < n and j - i < 128 and (j + 1 >= n or data[j] != data[j + 1]):
                j += 1
            out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, most significant first, widened one code early; 256 clears, 257 ends."""
    out = bytearray()
    table: list[bytes] = []
    width, acc, held, last = 9, 0, 0, b""
    for byte in data:
        acc = (acc << 8 | byte) & 0xFFFFFF
        held += 8
        if held < width:
            continue
        held -= width
        code = acc >> held & (1 << width) - 1
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257 or len(out) >= size:
            break
        if not last:
            if code > 255 or not table:
                raise TiffError("LZW code without a table")
            word = table[code]
        else:
            if code > len(table):
                raise TiffError("LZW code out of order")
            word = table[code] if code < len(table) else last + last[:1]
            if len(table) < 4096:
                table.append(last + word[:1])
        out += word
        last = word
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    out, acc, held = bytearray(), 0, 0
    fresh = {bytes((i,)): i for i in range(256)}
    table, n, width, word = dict(fresh), 258, 9, b""

    def put(code: int) -> None:
        nonlocal acc, held
        acc, held = acc << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(acc >> held & 255)
        acc &= (1 << held) - 1

    put(256)
    for i in range(len(data)):
        more = word + data[i : i + 1]
        if more in table:
            word = more
            continue
        put(table[word])
        table[more], n, word = n, n + 1, data[i : i + 1]
        if n > 4094:
            put(256)
            table, n, width = dict(fresh), 258, 9
        else:
            width = n.bit_length()
    if word:
        put(table[word])
        width = min(12, (n + 1).bit_length())
    put(257)
    if held:
        out.append(acc << 8 - held & 255)
    return bytes(out)


def _decode(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        raw = data
    elif compression in (DEFLATE, OLD_DEFLATE):
        raw = zlib.decompressobj().decompress(data, size)
    elif compression == PACKBITS:
        raw = unpack_bits(data, size)
    elif compression == LZW:
        raw = unpack_lzw(data, size)
    else:
        raise TiffError(f"compression {compression}")
    if len(raw) < size:
        raise TiffError(f"{len(raw)} of {size} bytes in a strip or tile")
    return raw[:size]


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """The tags of each image directory, in order; a chain that loops ends."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise TiffError("not a TIFF")
    big = struct.unpack_from(order + "H", data, 2)[0]
    if big not in (42, 43):
        raise TiffError("not a TIFF")
    wide = big == 43
    at = struct.unpack_from(order + ("Q" if wide else "I"), data, 8 if wide else 4)[0]
    count, offset, entry = ("Q", "Q", 20) if wide else ("H", "I", 12)
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        try:
            n = struct.unpack_from(order + count, data, at)[0]
            first = at + struct.calcsize(count)
            tags = {}
            for k in range(first, first + n * entry, entry):
                tag, kind = struct.unpack_from(order + "HH", data, k)
                many = struct.unpack_from(order + offset, data, k + 4)[0]
                if kind not in TYPES:
                    continue
                form, room = TYPES[kind], 8 if wide else 4
                step = struct.calcsize("=" + form)
                where = k + 4 + struct.calcsize(offset)
                if step * many > room:
                    where = struct.unpack_from(order + offset, data, where)[0]
                if where + step * many > len(data):
                    raise TiffError(f"tag {tag} ends beyond the file")
                tags[tag] = struct.unpack_from(order + form * many, data, where)
            at = struct.unpack_from(order + offset, data, first + n * entry)[0]
        except struct.error as e:
            raise TiffError(f"directory cut short: {e}") from None
        yield tags | {"order": order}


def _undo(block: np.ndarray, predictor: int) -> np.ndarray:
    """``block``: rows, columns, samples."""
    if predictor == 1:
        return block
    if predictor == 2 and block.dtype.kind in "ui":
        return np.cumsum(block, axis=1, dtype=block.dtype)
    raise TiffError(f"predictor {predictor} on {block.dtype}")


def _undo_float(raw: bytes, rows: int, cols: int, spp: int, dtype: np.dtype) -> np.ndarray:
    """Bytes of a row are differenced, and stored by significance, the most significant first."""
    b = np.frombuffer(raw, np.uint8).reshape(rows, cols * spp * dtype.itemsize).copy()
    step = b.reshape(rows, -1, spp)
    b = np.cumsum(step, axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, cols * spp)
    return np.ascontiguousarray(b.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, cols, spp).astype(dtype)


def read_page(data: bytes, tags: dict) -> np.ndarray:
    """Samples of one directory as rows x columns x samples, in native byte order."""
    one = lambda t, d=None: tags[t][0] if tags.get(t) else d
    width, height, spp = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    if not width or not height:
        raise TiffError("no width or height")
    bits, compression, predictor, planar = one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
    if len(set(tags.get(BITS, (1,)))) > 1:
        raise TiffError("samples of different widths")
    kinds = {1: "u", 2: "i", 3: "f"}
    if bits == 1:
        dtype = np.dtype("u1")
    elif bits in (8, 16, 32, 64) and one(FORMAT, 1) in kinds and (bits, one(FORMAT, 1)) != (8, 3):
        dtype = np.dtype(f"{kinds[one(FORMAT, 1)]}{bits // 8}")
    else:
        raise TiffError(f"{bits} bits of format {one(FORMAT, 1)}")
    tiled = TILE_WIDTH in tags
    tw, th = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(height, one(ROWS_PER_STRIP, height)))
    offsets, counts = (tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS), tags.get(TILE_COUNTS if tiled else STRIP_COUNTS))
    if not offsets or not counts or not tw or not th:
        raise TiffError("no strips or tiles")
    across, down = -(-width // tw), -(-height // th)
    planes, within = (spp, 1) if planar == 2 and spp > 1 else (1, spp)
    if len(offsets) < across * down * planes or len(counts) < len(offsets):
        raise TiffError("strips or tiles are missing")
    size = width * height * spp * dtype.itemsize
    if size >= 1 << 31:
        raise TiffError("a page of over 2 GB, which no binary value can hold")
    if size > MOST_EXPANDED * len(data):
        raise TiffError("more samples than the file can hold")
    out = np.empty((height, width, spp), dtype)
    for plane in range(planes):
        for k in range(across * down):
            y, x = k // across * th, k % across * tw
            rows = th if tiled else min(th, height - y)
            i = plane * across * down + k
            piece = data[offsets[i] : offsets[i] + counts[i]]
            if bits == 1:
                row = -(-tw * within // 8)
                raw = _decode(piece, compression, rows * row)
                block = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, row), axis=1)[:, : tw * within].reshape(rows, tw, within)
            else:
                raw = _decode(piece, compression, rows * tw * within * dtype.itemsize)
                if predictor == 3 and dtype.kind == "f":
                    block = _undo_float(raw, rows, tw, within, dtype)
                else:
                    block = np.frombuffer(raw, dtype.newbyteorder(tags["order"])).astype(dtype).reshape(rows, tw, within)
                    block = _undo(block, predictor)
            h, w = min(rows, height - y), min(tw, width - x)
            out[y : y + h, x : x + w, plane if planes > 1 else slice(None)] = block[:h, :w, 0] if planes > 1 else block[:h, :w]
    return out


def encode(pages: list[np.ndarray], compression: str = "deflate", predictor: int = 1, rows_per_strip: int | None = None, tile: tuple[int, int] | None = None, order: str = "<", big: bool = False, planar: int = 1) -> bytes:
    """A TIFF of pages of rows x columns (x samples); ``tile`` is (width, height)."""
    out = bytearray((b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)))
    link = len(out) - (8 if big else 4)
    count, offset, room = ("Q", "Q", 8) if big else ("H", "I", 4)
    code = CODECS[compression]
    for page in pages:
        page = page[:, :, None] if page.ndim == 2 else page
        h, w, spp = page.shape
        tw, th = tile or (w, rows_per_strip or h)
        offsets, counts = [], []
        for plane in [slice(s, s + 1) for s in range(spp)] if planar == 2 else [slice(None)]:
            for y in range(0, h, th):
                for x in range(0, w, tw):
                    block = page[y : y + th, x : x + tw, plane]
                    if tile:
                        block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1]), (0, 0)))
                    if predictor == 2:
                        block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1).astype(page.dtype)
                    if predictor == 3:
                        n = page.dtype.itemsize
                        b = np.ascontiguousarray(block.astype(page.dtype.newbyteorder(">"))).view(np.uint8).reshape(block.shape[0], -1, n)
                        b = np.ascontiguousarray(b.transpose(0, 2, 1)).reshape(block.shape[0], -1, block.shape[2])
                        raw = np.concatenate([b[:, :1], np.diff(b, axis=1)], axis=1).astype(np.uint8).tobytes()
                    else:
                        raw = block.astype(page.dtype.newbyteorder(order)).tobytes()
                    if code == DEFLATE:
                        raw = zlib.compress(raw, 1)
                    elif code != NONE:
                        raw = (pack_lzw if code == LZW else pack_bits)(raw)
                    offsets.append(len(out))
                    counts.append(len(raw))
                    out += raw
        long = "Q" if big else "I"
        kind = 16 if big else 4
        tags = [
            (WIDTH, 4, "I", [w]), (HEIGHT, 4, "I", [h]), (BITS, 3, "H", [page.dtype.itemsize * 8] * spp), (COMPRESSION, 3, "H", [code]), (PHOTOMETRIC, 3, "H", [1]),
            (SAMPLES, 3, "H", [spp]), (PLANAR, 3, "H", [planar]), (PREDICTOR, 3, "H", [predictor]), (FORMAT, 3, "H", [{"u": 1, "i": 2, "f": 3}[page.dtype.kind]] * spp),
        ]
        if tile:
            tags += [(TILE_WIDTH, 4, "I", [tw]), (TILE_HEIGHT, 4, "I", [th]), (TILE_OFFSETS, kind, long, offsets), (TILE_COUNTS, kind, long, counts)]
        else:
            tags += [(STRIP_OFFSETS, kind, long, offsets), (ROWS_PER_STRIP, 4, "I", [th]), (STRIP_COUNTS, kind, long, counts)]
        entries = []
        for tag, kind_, form, values in sorted(tags):
            raw = struct.pack(order + form * len(values), *values)
            if len(raw) > room:
                out += b"\0" * (len(out) % 2)
                raw, at = struct.pack(order + offset, len(out)), raw
                out += at
            entries.append(struct.pack(order + "HH" + offset, tag, kind_, len(values)) + raw.ljust(room, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + offset, out, link, len(out))
        out += struct.pack(order + count, len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0" * room
    return bytes(out)


def pages_of(data: bytes | None) -> Iterator[tuple]:
    """The values of ``PAGE`` for each page."""
    k = 0
    try:
        for tags in directories(data or b""):
            image = read_page(data, tags)
            yield k, image.shape[1], image.shape[0], image.shape[2], image.dtype.name, image.tobytes(), float(image.mean(dtype=np.float64)), float(image.std(dtype=np.float64)), None
            k += 1
    except (ValueError, TypeError, ArithmeticError, LookupError, MemoryError, struct.error, zlib.error) as e:  # TiffError, and what damaged tags bring about
        yield None, None, None, None, None, None, None, None, str(e)[:200] or type(e).__name__


PAGE = T.StructType([
    T.StructField("page", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("samples", T.IntegerType()),
    T.StructField("dtype", T.StringType()), T.StructField("pixels", T.BinaryType()),
    T.StructField("mean", T.DoubleType()), T.StructField("deviation", T.DoubleType()), T.StructField("error", T.StringType()),
])
FLUSH = 8 << 20


def decode_pages(df: DataFrame, column: str = "media") -> DataFrame:
    """A row per page: the columns of ``df`` but for ``column`` and names of ``PAGE``, then ``PAGE``."""
    keep = [f for f in df.schema.fields if f.name not in {column, *PAGE.names}]
    schema = T.StructType(keep + PAGE.fields)
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cols, held = [], [], 0
            media, rest = batch.column(column), batch.select(names) if names else None

            def made(rows: list[int], cols: list[tuple], rest=rest) -> pa.RecordBatch:
                arrays = rest.take(pa.array(rows, pa.int32())).columns if rest is not None else []
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.float64(), pa.float64(), pa.string())
                return pa.RecordBatch.from_arrays([*arrays, *(pa.array(c, t) for c, t in zip(zip(*cols, strict=True), kinds, strict=True))], names=[*names, *PAGE.names])

            for i in range(batch.num_rows):
                for page in pages_of(media[i].as_py()):
                    rows.append(i)
                    cols.append(page)
                    held += len(page[5] or b"")
                    if held > FLUSH:
                        yield made(rows, cols)
                        rows, cols, held = [], [], 0
            if rows:
                yield made(rows, cols)

    return df.select(*names, column).mapInArrow(run, schema)


def encode_bytes(df: DataFrame, column: str, key: str, width: int = 64, compression: str = "deflate") -> DataFrame:
    """``key``, ``n_bytes`` and ``media``: the UTF-8 of ``column`` (null: empty), padded with zero bytes to a positive multiple of ``width``, as rows of 8-bit samples."""
    kind = df.schema[key]
    schema = T.StructType([kind, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media, start, held = [], [], 0, 0
            keys, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                raw = (texts[i].as_py() or "").encode()
                padded = raw + b"\0" * (max(width, -(-len(raw) // width) * width) - len(raw))
                sizes.append(len(raw))
                media.append(encode([np.frombuffer(padded, np.uint8).reshape(-1, width)], compression))
                held += len(media[-1])
                if held > FLUSH or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([keys.slice(start, i + 1 - start), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])
                    sizes, media, start, held = [], [], i + 1, 0

    return df.select(key, column).mapInArrow(run, schema)
