"""TIFF and WARC round trips."""

import base64
import gzip
import hashlib
import struct
import zlib

import numpy as np
import pytest

from quillon.llm import tiff, warc

RNG = np.random.default_rng(3)


def image(h, w, s, dtype):
    if np.dtype(dtype).kind == "f":
        return RNG.normal(size=(h, w, s)).astype(dtype)
    info = np.iinfo(dtype)
    smooth = np.cumsum(RNG.integers(0, 3, (h, w, s)), axis=1)
    return np.where(RNG.random((h, w, s)) < 0.7, smooth, RNG.integers(info.min, info.max, (h, w, s))).astype(dtype)


def decoded(data):
    return [tiff.read_page(data, t) for t in tiff.directories(data)]


@pytest.mark.parametrize("compression", ["none", "packbits", "lzw", "deflate"])
@pytest.mark.parametrize(("order", "big"), [("<", False), (">", False), ("<", True), (">", True)])
@pytest.mark.parametrize(("dtype", "predictor", "shape", "layout"), [
    ("u1", 1, (37, 53, 1), {}), ("u1", 2, (37, 53, 3), {"rows_per_strip": 8}), ("u2", 2, (20, 33, 1), {"tile": (16, 16)}), ("f4", 3, (21, 17, 2), {"tile": (16, 16)}), ("f8", 3, (9, 5, 1), {"rows_per_strip": 4}), ("u1", 1, (40, 40, 3), {"planar": 2, "tile": (32, 16)}), ("i4", 1, (5, 7, 2), {}),
])
def test_round_trip(compression, order, big, dtype, predictor, shape, layout):
    pages = [image(*shape, dtype), image(3, 2, shape[2], dtype)]
    got = decoded(tiff.encode(pages, compression, predictor, order=order, big=big, **layout))
    assert len(got) == 2 and all(np.array_equal(a, b) for a, b in zip(got, pages, strict=True))


@pytest.mark.parametrize("data", [b"", b"a", b"aaaa", bytes(range(256)) * 30, b"ab" * 9000, b"\0" * 70000, RNG.integers(0, 256, 20000, dtype=np.uint8).tobytes(), b"abc" * 50 + b"x" * 300])
def test_codecs(data):
    assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data
    assert tiff.unpack_lzw(tiff.pack_lzw(data), len(data)) == data


def test_known_lzw_code_stream():
    # clear, 7, 258, 8, 8, 258, 6, 6, end: the example of the TIFF 6.0 specification
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    data = int(bits.ljust(88, "0"), 2).to_bytes(11, "big")
    assert tiff.unpack_lzw(data, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_bilevel_page():
    rows = np.packbits(np.eye(10, dtype=np.uint8), axis=1).tobytes()
    tags = [(256, 3, 10), (257, 3, 10), (258, 3, 1), (259, 3, 1), (273, 4, 8), (278, 3, 10), (279, 4, len(rows))]
    body = b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags)
    data = struct.pack("<2sHI", b"II", 42, 8 + len(rows)) + rows + struct.pack("<H", len(tags)) + body + struct.pack("<I", 0)
    assert np.array_equal(decoded(data)[0][:, :, 0], np.eye(10, dtype=np.uint8))


def test_decode_pages(spark):
    good = tiff.encode([image(4, 6, 1, "u1"), image(2, 2, 3, "u1")], "lzw", 2)
    loop = bytearray(tiff.encode([image(4, 6, 1, "u1")]))
    loop[-4:] = loop[4:8]
    rows = [(1, good, "a"), (1, good, "a"), (2, None, "b"), (3, b"", "c"), (4, b"MM\0\x2a", "d"), (5, good[:-30], "e"), (6, bytes(loop), "f")]
    df = spark.createDataFrame(rows, "id long, media binary, page string")
    got = [(r["id"], r["page"], r["width"], r["error"] is None) for r in tiff.decode_pages(df, "media").collect()]
    assert sorted(got, key=str)[:4] == [(1, 0, 6, True), (1, 0, 6, True), (1, 1, 2, True), (1, 1, 2, True)]
    assert {g for g in got if g[0] in (2, 3, 4)} == {(k, None, None, False) for k in (2, 3, 4)}
    assert (5, None, None, False) in got and [g for g in got if g[0] == 6] == [(6, 0, 6, True)]
    assert tiff.decode_pages(df.limit(0), "media").collect() == []


def test_known_packed_bits():
    # the example of Apple's technical note 1023
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.unpack_bits(packed, 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)


def foreign(compression, predictor, pieces, layout, order=">"):
    """A file laid out as other writers do: the directory first, pieces in reverse, odd tag types, unknown tags."""
    n = len(pieces)
    tags = [(254, 4, [0]), (256, 3, [16]), (257, 4, [16]), (258, 3, [8]), (259, 3, [compression]), (262, 3, [1]), (270, 2, list(b"made elsewhere\0")), (277, 3, [1]), (305, 2, list(b"x\0")), (317, 3, [predictor]), (65000, 99, [1])]
    tags += [(t, k, v if v is not None else [0] * n) for t, k, v in layout]
    size = {2: 1, 3: 2, 4: 4, 99: 4}
    tags.sort()
    where = 8 + 2 + 12 * len(tags) + 4
    extra = b""
    after = where + sum(size[k] * len(v) for _, k, v in tags if size[k] * len(v) > 4)
    offsets, at = [0] * n, after
    for k in reversed(range(n)):
        offsets[k], at = at, at + len(pieces[k])
    body = b""
    for tag, kind, values in tags:
        values = offsets if tag in (273, 324) else [len(p) for p in pieces] if tag in (279, 325) else values
        raw = struct.pack(order + {1: "B", 2: "H", 4: "I"}[size[kind]] * len(values), *values)
        if len(raw) > 4:
            body += struct.pack(order + "HHII", tag, kind, len(values), where + len(extra))
            extra += raw
        else:
            body += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    head = (b"MM" if order == ">" else b"II") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(tags)) + body + bytes(4)
    return head + extra + b"".join(pieces[k] for k in reversed(range(n)))


def plain_lzw(data):
    """A coder that clears its table at every 100th code and writes bits as text."""
    bits, table, size, codes = f"{256:09b}", {bytes([k]): k for k in range(256)}, 258, 0
    omega = b""
    for k in range(len(data)):
        one = data[k : k + 1]
        if omega + one in table:
            omega += one
            continue
        width = 9 if size < 511 else 10
        bits += f"{table[omega]:0{width}b}"
        table[omega + one], size, omega, codes = size, size + 1, one, codes + 1
        if codes % 100 == 0:
            bits += f"{table[omega]:0{9 if size < 511 else 10}b}"
            size += 1
            bits += f"{256:0{9 if size < 511 else 10}b}"
            table, size, omega = {bytes([k]): k for k in range(256)}, 258, b""
    if omega:
        bits += f"{table[omega]:0{9 if size < 511 else 10}b}"
        size += 1
    bits += f"{257:0{9 if size < 511 else 10}b}"
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


@pytest.mark.parametrize("order", [">", "<"])
def test_files_of_other_writers(order):
    page = np.add.outer(np.arange(16), 3 * np.arange(16)).astype(np.uint8) // 5
    differ = np.concatenate([page[:, :1], np.diff(page, axis=1)], 1).astype(np.uint8)
    strips = lambda p: [p[k : k + 5].tobytes() for k in range(0, 16, 5)]
    tiles = lambda p: [p[y : y + 16, x : x + 8].ravel() for y in (0,) for x in (0, 8)]
    by_strip, by_tile = [(273, 4, None), (278, 3, [5]), (279, 3, None)], [(322, 3, [8]), (323, 3, [16]), (324, 4, None), (325, 4, None)]
    literal = lambda raw: b"".join(bytes([len(raw[k : k + 100]) - 1]) + raw[k : k + 100] + b"\x80" for k in range(0, len(raw), 100))
    tile_differ = [np.concatenate([t.reshape(16, 8)[:, :1], np.diff(t.reshape(16, 8), axis=1)], 1).astype(np.uint8).tobytes() for t in tiles(page)]
    files = [
        foreign(1, 1, strips(page), by_strip, order), foreign(32773, 1, list(map(literal, strips(page))), by_strip, order), foreign(5, 2, list(map(plain_lzw, strips(differ))), by_strip, order),
        foreign(8, 2, [zlib.compress(x, 9) for x in tile_differ], by_tile, order), foreign(32946, 1, [zlib.compress(x.tobytes()) for x in tiles(page)], by_tile, order),
    ]
    for data in files:
        got = decoded(data)
        assert len(got) == 1 and np.array_equal(got[0][:, :, 0], page)


def test_damaged_files_give_rows():
    rng = np.random.default_rng(9)
    whole = [tiff.encode([image(9, 13, 1, "u1"), image(4, 4, 2, "f4")], c, big=big, **kw) for c in tiff.CODECS for big in (False, True) for kw in ({}, {"tile": (16, 16)})]
    whole += [struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16), b"II\x2b\0\x08\0\0\0", foreign(1, 1, [b"x" * 256], [(273, 4, None), (278, 3, [16]), (279, 3, None)])]
    n_errors = 0
    for k in range(1000):
        data = bytearray(whole[k % len(whole)])
        for _ in range(rng.integers(1, 6)):
            data[rng.integers(len(data))] = rng.integers(256)
        if k % 3 == 0:
            data = data[: rng.integers(len(data) + 1)]
        rows = list(tiff.pages_of(bytes(data)))
        assert all((r[0] is None) == (r[8] is not None) for r in rows) and all(r[5] is None or len(r[5]) <= tiff.MOST_EXPANDED * len(data) for r in rows)
        n_errors += any(r[8] is not None for r in rows)
    assert 300 < n_errors < 1000
    for data in whole[-3:-1]:
        assert [r[0] for r in tiff.pages_of(data)] in ([None], [])


def test_the_query_matches_a_plain_version(spark):
    from quillon.llm.queries import op6_tiff

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op6_tiff(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        pixels = np.frombuffer(payload, np.uint8)
        media = tiff.encode([pixels.reshape(-1, 64)])
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
        shape, kind, mean, deviation = r["feature"].split()
        assert tuple(r)[1:7] == want and (shape, kind) == (f"64x{len(payload) // 64}x1", "uint8"), r["doc_id"]
        # halves of the last digit are rounded either way
        assert float(mean.removeprefix("mean=")) == pytest.approx(pixels.mean(), abs=1e-6) and float(deviation.removeprefix("deviation=")) == pytest.approx(pixels.std(), abs=1e-6)


def test_stored_texts(odd_docs, no_docs):
    out = tiff.decode_pages(tiff.encode_bytes(odd_docs, "text", "doc_id"), "media").collect()
    want = sorted(((t or "").encode() for t in [r["text"] for r in odd_docs.collect()]), key=len)
    got = sorted(out, key=lambda r: r["n_bytes"])
    assert [r["n_bytes"] for r in got] == [len(w) for w in want]
    for r, w in zip(got, want, strict=True):
        assert len(r["pixels"]) % 64 == 0 and bytes(r["pixels"]).rstrip(b"\0") == w.rstrip(b"\0") and r["error"] is None
    assert tiff.encode_bytes(no_docs, "text", "doc_id").collect() == []


# WARC

def test_archives_round_trip(spark, where):
    pages = [(1, "http://a/1", "<p>é\r\n\r\nWARC/1.1\r\n"), (2, "http://a/2", "same"), (5, "http://a/5", "same"), (3, None, "same"), (4, "u", None), (6, "u v\nw", ""), (None, "n", "same"), (7, "long", "x" * 300_000), (8, "d", "dup"), (8, "d", "dup"), (None, "o", "only")]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in pages], "page_id long, url string, html string, digest string")
    archives = warc.write_archives(df.repartition(3), f"{where}/warc", where)
    index = warc.build_index(archives)
    read = warc.read_records(index)
    rows = [r.asDict() for r in warc.resolve(read).collect()]
    assert len(rows) == len(pages)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    got = sorted(((r["id"], r["payload_bytes"], r["digest"], r["record_type"], r["refers_to"]) for r in rows), key=str)
    first = {"": 6, "same": 5, "dup": 8}
    want = []
    for i, _, h in pages:
        f = first.get(h or "")
        again = f is not None and f != i
        want.append((i, len((h or "").encode()), digest(h), "revisit" if again else "response", f if again else None))
    assert got == sorted(want, key=str)
    assert {bytes(r["payload"]).decode() for r in rows if r["record_type"] == "response"} == {"<p>é\r\n\r\nWARC/1.1\r\n", "same", "", "x" * 300_000, "dup", "only"}
    assert {r["url"] for r in rows if r["id"] == 6} == {"u v w"}
    some = warc.read_records(index.where("id in (1, 7)")).collect()
    assert sorted(r["id"] for r in some) == [1, 7]


def test_minimum_size_of_shared_payloads(spark, where):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    index = warc.build_index(warc.write_archives(df, f"{where}/warc", where, min_bytes=5))
    assert sorted((r["id"], r["record_type"]) for r in index.collect()) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]


def test_no_pages(spark, where):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    index = warc.build_index(warc.write_archives(df, f"{where}/warc", where))
    assert warc.resolve(warc.read_records(index)).collect() == []


def test_foreign_archives(spark, tmp_path):
    """Records of other writers, gzipped by member and plain; the digest is made where none is given."""
    body = b"HTTP/1.1 200 OK\r\n\r\nhi"
    one = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    two = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Target-URI: http://x/\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    (tmp_path / "b.warc").write_bytes(one + two)
    index = warc.build_index(warc.archive_listing(spark, [str(tmp_path / "a.warc.gz"), str(tmp_path / "b.warc")]))
    rows = warc.read_records(index.where("url is not null")).collect()
    assert [bytes(r["payload"]) for r in rows] == [body, body] and {r["digest"] for r in rows} == {warc.payload_digest(body)}
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(two)[:-9])
    with pytest.raises(ValueError, match="ends within"):
        list(warc.members(str(tmp_path / "c.warc.gz")))


def test_reads_are_coalesced():
    assert warc.coalesced([(0, 10), (10, 5), (16, 4), (100, 1)], gap=2, most=1000) == [(0, 3, 20), (3, 4, 101)]
    assert warc.coalesced([(0, 10), (10, 10)], gap=2, most=15) == [(0, 1, 10), (1, 2, 20)]
    assert warc.coalesced([]) == [] and zlib.crc32(b"123456789") == 0xCBF43926
