"""TIFF media columns: lossless 8-bit storage, and a reader that emits one row per page.

The reader walks the chain of image directories of a classic TIFF in either byte order,
decodes strips and tiles stored plainly or with PackBits, LZW or deflate, and undoes
horizontal differencing (predictor 2, on 8-, 16- and 32-bit samples) and floating-point
differencing (predictor 3). Null bytes give no page; a damaged file gives one row whose
``error`` says why and whose other columns are null. A page that claims more samples than its
bytes could hold under any of the schemes is damaged, so a small file can't ask for much memory.

``texts_to_tiff`` stores each text in a layout that follows from the text alone: scheme, predictor, strips or
tiles, and pages of a number of rows. ``join_pages`` puts the pages of a file together again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meridia.llm.tokens import pieces_of_batch
from meridia.llm.workspace import ship, tidy

# Fixed values of the TIFF 6.0 format: field types' sizes, tags and compression schemes.
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
INT_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 13: "I"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
SCHEMES = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}
OLD_DEFLATE = 32946
#: No scheme expands by more: the longest LZW entry, 4096 bytes, takes 12 bits.
EXPANSION = 4096

PAGE_COLUMNS = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"


def pack_bits(data: bytes) -> bytes:
    """PackBits: runs of 2-128 equal bytes as (1-n, byte), stretches as (n-1, bytes)."""
    a = np.frombuffer(data, dtype=np.uint8)
    if not len(a):
        return b""
    edges = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]])
    out, plain = bytearray(), 0
    def literal(lo: int, hi: int) -> None:
        for x in range(lo, hi, 128):
            y = min(hi, x + 128)
            out.append(y - x - 1)
            out.extend(data[x:y])
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if hi - lo < 3:
            continue
        literal(plain, lo)
        while hi - lo >= 2:
            n = min(128, hi - lo)
            out += bytes((257 - n, data[lo]))
            lo += n
        plain = lo
    literal(plain, len(a))
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def lzw_compress(data: bytes) -> bytes:
    """TIFF's LZW: most significant bit first; widths grow one code early; 256 clears, 257 ends."""
    acc = bits = 0
    out = bytearray()
    table, width = {bytes((i,)): i for i in range(256)}, 9
    following = 258
    def put(code: int) -> None:
        nonlocal acc, bits
        acc = (acc << width) | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append((acc >> bits) & 255)
        acc &= (1 << bits) - 1
    put(256)
    run = b""
    for i in range(len(data)):
        longer = run + data[i : i + 1]
        if longer in table:
            run = longer
            continue
        put(table[run])
        table[longer] = following
        following += 1
        if following == 4094:
            put(256)
            table, width, following = {bytes((b,)): b for b in range(256)}, 9, 258
        elif following > (1 << width) - 1 and width < 12:
            width += 1
        run = data[i : i + 1]
    if run:
        put(table[run])
        following += 1
        if following > (1 << width) - 1 and width < 12:
            width += 1
    put(257)
    if bits:
        out.append((acc << (8 - bits)) & 255)
    return bytes(out)


def lzw_expand(data: bytes, size: int) -> bytes:
    out, table, width, last = bytearray(), [], 9, None
    acc = bits = i = 0
    while len(out) < size or last is None:
        while bits < width:
            if i >= len(data):
                return bytes(out)
            acc = ((acc << 8) | data[i]) & 0xFFFFFFFF
            bits += 8
            i += 1
        bits -= width
        code = (acc >> bits) & ((1 << width) - 1)
        acc &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((b,)) for b in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            if not table:
                raise ValueError("LZW data doesn't start with a clear code")
            piece = table[code]
        else:
            if code > len(table):
                raise ValueError("LZW code out of range")
            piece = table[code] if code < len(table) else last + last[:1]
            table.append(last + piece[:1])
        out += piece
        last = piece
        if len(table) > (1 << width) - 2 and width < 12:
            width += 1
    return bytes(out)


def compress(data: bytes, scheme: str) -> bytes:
    if scheme == "deflate":
        return zlib.compress(data, 1)
    return {"none": bytes, "packbits": pack_bits, "lzw": lzw_compress}[scheme](data)


def expand(data: bytes, code: int, size: int) -> bytes:
    if code == 1:
        return data
    if code in (8, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if code == 5:
        return lzw_expand(data, size)
    if code == 32773:
        return unpack_bits(data, size)
    raise ValueError(f"compression {code} isn't supported")


def differences(block: np.ndarray) -> np.ndarray:
    """Predictor 2 forwards on (rows, columns, samples)."""
    out = block.copy()
    out[:, 1:] = block[:, 1:] - block[:, :-1]
    return out


def undo(block: bytes, rows: int, columns: int, samples: int, bits: int, predictor: int, order: str, is_float: bool) -> np.ndarray:
    """Samples of one strip or tile as (rows, columns, samples) in native byte order."""
    wide = bits // 8
    kind = np.dtype(f"{order}f{wide}" if is_float else f"{order}u{wide}")
    if predictor == 3:
        raw = np.frombuffer(block, dtype=np.uint8, count=rows * columns * samples * wide).reshape(rows, columns * wide, samples)
        planes = np.cumsum(raw, axis=1, dtype=np.uint8).reshape(rows, wide, columns * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{wide}").reshape(rows, columns, samples).astype(f"=f{wide}")
    image = np.frombuffer(block, dtype=kind, count=rows * columns * samples).reshape(rows, columns, samples)
    image = image.astype(kind.newbyteorder("="))
    return np.cumsum(image, axis=1, dtype=image.dtype) if predictor == 2 else image


def write_page(image: np.ndarray, scheme: str = "deflate", predictor: int = 1, tile: int = 0, rows_per_strip: int = 1024) -> dict[int, object]:
    """One page of unsigned samples (rows, columns[, samples]) as tags and compressed blocks."""
    image = image[:, :, None] if image.ndim == 2 else image
    high, wide, samples = image.shape
    blocks = []
    if tile:
        for y in range(0, high, tile):
            for x in range(0, wide, tile):
                block = np.zeros((tile, tile, samples), dtype=image.dtype)
                part = image[y : y + tile, x : x + tile]
                block[: part.shape[0], : part.shape[1]] = part
                blocks.append(block)
    else:
        blocks = [image[y : y + rows_per_strip] for y in range(0, high, rows_per_strip)]
    little = image.dtype.newbyteorder("<")
    stored = [compress((differences(b) if predictor == 2 else b).astype(little).tobytes(), scheme) for b in blocks]
    tags: dict[int, object] = {WIDTH: wide, HEIGHT: high, BITS: [image.dtype.itemsize * 8] * samples, COMPRESSION: SCHEMES[scheme], PHOTOMETRIC: 1, SAMPLES: samples, PLANAR: 1, PREDICTOR: predictor, SAMPLE_FORMAT: [1] * samples}
    tags |= {TILE_WIDTH: tile, TILE_HEIGHT: tile} if tile else {ROWS_PER_STRIP: rows_per_strip}
    return tags | {"blocks": stored}


def write_tiff(pages: list[dict[int, object]]) -> bytes:
    """A little-endian TIFF of pages from ``write_page``."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for page in pages:
        offsets = []
        for block in page["blocks"]:
            offsets.append(len(out))
            out += block
        tags = {k: v for k, v in page.items() if k != "blocks"}
        tiled = TILE_WIDTH in tags
        tags[TILE_OFFSETS if tiled else STRIP_OFFSETS] = offsets
        tags[TILE_COUNTS if tiled else STRIP_COUNTS] = [len(b) for b in page["blocks"]]
        short = {BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR, SAMPLE_FORMAT}
        entries = []
        for tag in sorted(tags):
            values = tags[tag] if isinstance(tags[tag], list) else [tags[tag]]
            code, form = (3, "H") if tag in short else (4, "I")
            raw = struct.pack(f"<{len(values)}{form}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                raw, at = struct.pack("<I", len(out)), raw
                out += at
            entries.append(struct.pack("<HHI", tag, code, len(values)) + raw.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list]]]:
    """Byte order and tags of each image directory in the chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack_from(f"{order}I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("the directories form a circle")
        seen.add(at)
        (n,) = struct.unpack_from(f"{order}H", data, at)
        tags = {}
        for k in range(n):
            where = at + 2 + 12 * k
            tag, code, count = struct.unpack_from(f"{order}HHI", data, where)
            if code not in INT_CODE:
                continue
            size = TYPE_SIZE[code] * count
            start = where + 8 if size <= 4 else struct.unpack_from(f"{order}I", data, where + 8)[0]
            tags[tag] = list(struct.unpack_from(f"{order}{count}{INT_CODE[code]}", data, start))
        yield order, tags
        (at,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)


def read_page(data: bytes, order: str, tags: dict[int, list]) -> dict[str, object]:
    one = lambda tag, default: tags.get(tag, [default])[0]
    wide, high, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    depths = set(tags.get(BITS, [1]))
    bits, code, predictor = one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
    if len(depths) > 1 or bits not in (8, 16, 32, 64):
        raise ValueError(f"samples of {sorted(depths)} bits aren't supported")
    is_float, planar = one(SAMPLE_FORMAT, 1) == 3, one(PLANAR, 1) == 2
    tiled = TILE_OFFSETS in tags
    bw, bh = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (wide, min(one(ROWS_PER_STRIP, high), high))
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    planes = samples if planar else 1
    each = samples // planes
    if wide < 1 or high < 1 or samples < 1 or bw < 1 or bh < 1:
        raise ValueError("a page without samples")
    if max(wide * high, bw * bh) * samples * bits // 8 > EXPANSION * (len(data) + 1):
        raise ValueError("more samples than the file can hold")
    image = np.zeros((high, wide, samples), dtype=f"f{bits // 8}" if is_float else f"u{bits // 8}")
    k = 0
    for plane in range(planes):
        for y in range(0, high, bh):
            for x in range(0, wide, bw):
                rows = bh if tiled else min(bh, high - y)
                block = expand(data[offsets[k] : offsets[k] + counts[k]], code, rows * bw * each * bits // 8)
                part = undo(block, rows, bw, each, bits, predictor, order, is_float)
                here = part[: high - y, : wide - x]
                image[y : y + bh, x : x + bw, plane if planar else slice(None)] = here[:, :, 0] if planar else here
                k += 1
    return {"width": wide, "height": high, "samples": samples, "bits": bits, "compression": code, "predictor": predictor, "tiled": tiled, "pixels": image.tobytes(), "error": None}


def pages(data: bytes | None) -> Iterator[dict[str, object]]:
    """One dict per page, numbered from 0; a damaged file ends with a dict that holds the error."""
    names = [c.split()[0] for c in PAGE_COLUMNS.split(", ")]
    if data is None:
        return
    k = 0
    try:
        for order, tags in directories(data):
            yield {"page": k, **read_page(data, order, tags)}
            k += 1
    except (ValueError, KeyError, IndexError, struct.error, zlib.error, OverflowError, MemoryError) as e:
        yield dict.fromkeys(names) | {"page": k, "error": f"{type(e).__name__}: {e}"}


def text_payload(text: bytes | None, line: int = 64) -> bytes:
    """The text's bytes, then bytes 0 up to a positive multiple of ``line``."""
    text = text or b""
    return text + b"\0" * (-len(text) % line if text else line)


def text_to_tiff(text: bytes | None, width: int = 64) -> bytes:
    """A text, padded to whole rows of ``width`` samples, as a TIFF whose layout follows from the payload's checksum:
    one of four schemes, with LZW and deflate one of two predictors, strips or tiles, and
    64 to 512 rows a page."""
    payload = text_payload(text, width)
    image = np.frombuffer(payload, dtype=np.uint8).reshape(-1, width)
    choice = zlib.crc32(payload)
    scheme = ("deflate", "lzw", "packbits", "none")[choice & 3]
    predictor = 1 + (choice >> 2 & 1) if scheme in ("deflate", "lzw") else 1
    tile = 64 if choice >> 3 & 1 else 0
    rows = 64 << (choice >> 4 & 3)
    return write_tiff([write_page(image[y : y + rows], scheme, predictor, tile, 64) for y in range(0, len(image), rows)])


def texts_to_tiff(df: DataFrame, text_col: str = "text", media_col: str = "media", width: int = 64) -> DataFrame:
    """Adds each text as a TIFF (see ``text_to_tiff``).

    A null text counts as empty and gives one row of zeros. Equal texts give equal files.
    A column named ``media_col`` is replaced; the others stay as they are.
    """
    ship(df.sparkSession)
    kept = df.drop(media_col)
    source = kept.withColumn(media_col, F.col(text_col).cast("string").cast("binary"))

    def run(batches):
        for whole in batches:
            for batch in pieces_of_batch(whole, media_col):
                media = [text_to_tiff(text, width) for text in batch.column(media_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(media, pa.binary())], names=batch.schema.names)

    return source.mapInArrow(tidy(run), source.schema)


def tiff_pages(df: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per page of each row's TIFF: the other columns, then page, width, height, samples,
    bits, compression, predictor, tiled, pixels and error (see the module's docstring). Columns of
    the input with these names, and the media column, are left out."""
    ship(df.sparkSession)
    own = [c.split()[0] for c in PAGE_COLUMNS.split(", ")]
    kept = [c for c in df.columns if c.lower() not in {*own, media_col.lower()}]
    source = df.select(*[df[f"`{c}`"] for c in kept], F.col(media_col).alias("__media"))
    spark_schema = df.select(*[df[f"`{c}`"] for c in kept]).schema
    for field in StructType.fromDDL(PAGE_COLUMNS):
        spark_schema = spark_schema.add(field)
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    fields = [c.split() for c in PAGE_COLUMNS.split(", ")]

    def run(batches):
        for whole in batches:
            for batch in pieces_of_batch(whole, "__media"):
                rows, found = [], []
                for i, media in enumerate(batch.column("__media").to_pylist()):
                    for page in pages(media):
                        rows.append(i)
                        found.append(page)
                taken = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-1]]
                made = [pa.array([p[n] for p in found], kinds[t]) for n, t in fields]
                yield pa.RecordBatch.from_arrays([*taken, *made], names=[*batch.schema.names[:-1], *(n for n, _ in fields)])

    return source.mapInArrow(tidy(run), spark_schema)


def join_pages(pages_of: DataFrame) -> DataFrame:
    """One row per file from the rows of ``tiff_pages``, which lie side by side as they were made, in the same task: the
    columns of the first page, but ``pixels`` of all pages one below the other, ``height`` their sum, and ``page``
    their number. A file with a damaged page has null pixels and that page's error."""
    schema = pages_of.schema
    at = {f.name: i for i, f in enumerate(schema)}

    def run(batches):
        kept: list | None = None  # the open file's first row, as a batch of one
        pixels: list[bytes | None] = []
        height, error = 0, None

        def closed(firsts, made):
            columns = list(pa.Table.from_batches(firsts).combine_chunks().to_batches()[0].columns)
            for name, kind in (("page", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())):
                columns[at[name]] = pa.array([m[name] for m in made], kind)
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        def file():
            whole = None if error is not None else pixels[0] if len(pixels) == 1 else b"".join(pixels)
            return {"page": len(pixels), "height": None if error is not None else height, "pixels": whole, "error": error}

        for batch in batches:
            firsts, made = [], []
            rows = zip(*(batch.column(at[c]).to_pylist() for c in ("page", "height", "pixels", "error")), strict=True)
            for i, (page, high, body, bad) in enumerate(rows):
                if page == 0:
                    if kept is not None:
                        firsts.append(kept)
                        made.append(file())
                    kept, pixels, height, error = batch.slice(i, 1), [], 0, None
                pixels.append(body)
                height, error = height + (high or 0), error if error is not None else bad
            if firsts:
                yield closed(firsts, made)
        if kept is not None:
            yield closed([kept], [file()])

    return pages_of.mapInArrow(tidy(run), schema)
