"""Per-image pixel jobs and metrics: NumPy over Arrow cells, images never leave their row.

Cells are read in place from Arrow's buffers, one image at a time, and Spark bounds a batch by
bytes (spark.sql.execution.arrow.maxBytesPerBatch). Steps that need more memory than the image
work in bands of rows, so a frame of 24 million pixels stays under 2 GB with its batch.
A null image gives null.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from shutterlake.functions.geometry import BLEND, GAIN

IMAGE = "width int, height int, rgba binary"
#: Little-endian float32 values: one for each place, or red, green and blue.
PLANE = "width int, height int, values binary"
#: Rows of a result that are worked on at a time.
BAND = 128

#: Places of red, both greens and blue in a 2x2 quad.
QUADS = {"RGGB": (0, 1, 2, 3), "BGGR": (3, 1, 2, 0), "GBRG": (2, 0, 3, 1), "GRBG": (1, 0, 3, 2)}


def normalized(raw: np.ndarray, black: list[float], white: list[float]) -> np.ndarray:
    """Each site of whole quads scaled from its black to its white level; a last odd row or
    column stays as it is."""
    out = raw.astype(np.float32)
    h, w = raw.shape[0] & ~1, raw.shape[1] & ~1
    for c in range(4):
        site = (slice(c // 2, h, 2), slice(c % 2, w, 2))
        out[site] = np.maximum(out[site] - np.float32(black[c]), 0) / np.float32(white[c] - black[c])
    return out


def shifted(cfa: str, x: int, y: int) -> str:
    """The quad's colours as seen from an area that starts at x, y."""
    return "".join(cfa[(r + y) % 2 * 2 + (c + x) % 2] for r in range(2) for c in range(2))


def superpixel(plane: np.ndarray, cfa: str, area: tuple[int, int, int, int]) -> np.ndarray:
    x, y, w, h = area
    part = plane[y : y + (h & ~1), x : x + (w & ~1)]
    sites = [part[c // 2 :: 2, c % 2 :: 2] for c in range(4)]
    red, green, other, blue = QUADS[shifted(cfa, x, y)]
    return np.stack([sites[red], (sites[green] + sites[other]) / 2, sites[blue]], axis=-1)


def calibrated(rgb: np.ndarray, gains: list[float], matrix: list[float]) -> np.ndarray:
    """Camera to linear sRGB, clipped to 0..1 by channel. Gains that aren't all positive
    and finite are all 1. ``matrix`` has 3 rows of 3 or 4."""
    g = np.array(gains[:3], np.float32)
    g = g if np.isfinite(g).all() and (g > 0).all() else np.ones(3, np.float32)
    m = np.array(matrix, np.float32).reshape(3, -1)[:, :3]
    return np.clip((rgb * g) @ m.T, 0, 1)


def tone_table() -> np.ndarray:
    v = np.arange(65_536) / 65_535
    v = GAIN * v / (1 + (GAIN - 1) * v)
    v = np.where(v <= 0.0031308, 12.92 * v, 1.055 * v ** (1 / 2.4) - 0.055)
    return ((v + BLEND * (v * v * (3 - 2 * v) - v)) * 255 + 0.5).astype(np.uint8)


_TONES = tone_table()


def packed(rgb: np.ndarray) -> np.ndarray:
    out = np.full((*rgb.shape[:2], 4), 255, np.uint8)
    for i in range(0, len(rgb), BAND):
        out[i : i + BAND, :, :3] = _TONES[(np.clip(rgb[i : i + BAND], 0, 1) * 65_535 + 0.5).astype(np.uint16)]
    return out


def developed(raw: np.ndarray, cfa: str, area: tuple[int, int, int, int], black: list, white: list, gains: list, matrix: list) -> np.ndarray | None:
    """Half-size opaque RGBA of an area, in bands that begin at even rows; None if the pattern
    isn't known."""
    x, y, w, h = area
    if shifted(cfa, x, y) not in QUADS:
        return None
    rows = len(raw[y : y + (h & ~1)]) // 2
    out = np.empty((rows, len(raw[0, x : x + (w & ~1)]) // 2, 4), np.uint8)
    for k in range(0, rows, BAND):
        n = min(BAND, rows - k)
        top, end = (y + 2 * k) & ~1, y + 2 * (k + n)
        plane = normalized(raw[top : end + (end & 1)], black, white)
        out[k : k + n] = packed(calibrated(superpixel(plane, cfa, (x, y + 2 * k - top, w, 2 * n)), gains, matrix))
    return out


def turned(image: np.ndarray, orientation: str) -> np.ndarray:
    return np.rot90(image, {"R0": 0, "R90": -1, "R180": 2, "R270": 1}[orientation])


def catmull_rom(size: int, to: int) -> np.ndarray:
    """Weights (to x size) of a Catmull-Rom filter, widened when shrinking."""
    scale = max(size / to, 1.0)
    center = (np.arange(to) + 0.5) * size / to - 0.5
    x = np.abs((np.arange(size)[None, :] - center[:, None]) / scale)
    w = np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))
    return w / w.sum(axis=1, keepdims=True)


def _along(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """weights @ rows for weights that are zero outside a band, by bands."""
    out = np.empty((len(weights), rows.shape[1]))
    for i in range(0, len(weights), BAND):
        own = weights[i : i + BAND]
        used = np.flatnonzero(own.any(axis=0))
        low, high = used[0], used[-1] + 1
        out[i : i + BAND] = own[:, low:high] @ rows[low:high]
    return out


def shrunk(image: np.ndarray, longest: int) -> np.ndarray:
    """Bands of rows of the result, each from the rows of the image that its filter reaches."""
    h, w = image.shape[:2]
    if max(h, w) <= longest:
        return image
    scale = longest / max(h, w)
    to = [max(1, math.floor(n * scale + 0.5)) for n in (h, w)]
    down, across = catmull_rom(h, to[0]), catmull_rom(w, to[1])
    out = np.empty((to[0], to[1], 4), np.uint8)
    step = max(1, int(BAND * to[0] / h))
    for i in range(0, to[0], step):
        own = down[i : i + step]
        used = np.flatnonzero(own.any(axis=0))
        rows = image[used[0] : used[-1] + 1]
        part = (own[:, used[0] : used[-1] + 1] @ rows.reshape(len(rows), -1).astype(np.float64)).reshape(len(own), w, 4)
        part = _along(across, part.transpose(1, 0, 2).reshape(w, -1)).reshape(to[1], len(own), 4).transpose(1, 0, 2)
        out[i : i + step] = np.clip(part + 0.5, 0, 255)
    return out


# ---- cells


def cells(column: pa.Array) -> list[np.ndarray | None]:
    """The bytes of each cell of a binary column, where they lie."""
    wide = pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else []
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return [held[at[i] : at[i + 1]] if ok else None for i, ok in enumerate(column.is_valid().to_pylist())]


def images(column: pa.StructArray) -> list[tuple[int, int, np.ndarray] | None]:
    """width, height and bytes of each image or plane."""
    width, height, data = column.flatten()
    every = zip(width.to_pylist(), height.to_pylist(), cells(data))
    return [None if None in (w, h) or d is None else (w, h, d) for w, h, d in every]


def image_array(found: list[np.ndarray | None], name: str) -> pa.StructArray:
    """A column of images; their bytes are copied once at most."""
    parts = [np.empty(0, np.uint8) if i is None else np.ascontiguousarray(i).reshape(-1).view(np.uint8) for i in found]
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    data = parts[0] if len(parts) == 1 else np.concatenate([*parts, np.empty(0, np.uint8)])
    none = pa.array([i is None for i in found], pa.bool_())
    mask = np.packbits(np.array([i is not None for i in found], bool), bitorder="little").tobytes()
    column = pa.Array.from_buffers(pa.binary(), len(found), [pa.py_buffer(mask), pa.py_buffer(at), pa.py_buffer(data)])
    size = [pa.array([None if i is None else i.shape[k] for i in found], pa.int32()) for k in (1, 0)]
    return pa.StructArray.from_arrays([*size, column], names=["width", "height", name], mask=none)


def floats(cell: tuple, *shape: int) -> np.ndarray:
    width, height, data = cell
    return data.view("<f4").reshape(height, width, *shape)


def rgba(cell: tuple) -> np.ndarray:
    width, height, data = cell
    return data.reshape(height, width, 4)


def mosaic(cell: tuple) -> np.ndarray:
    width, _, data = cell
    return data.view("<u2").reshape(-1, width)


def each(work: Callable, name: str) -> Callable:
    """A function of Arrow columns that gives the image ``work`` makes of each row's cells."""

    def run(column: pa.Array, *others: pa.Array) -> pa.Array:
        rest = zip(*(o.to_pylist() for o in others)) if others else [()] * len(column)
        return image_array([None if cell is None or None in more else work(cell, *more) for cell, more in zip(images(column), rest)], name)

    return run


rotate_cells = each(lambda cell, orientation: turned(rgba(cell), orientation), "rgba")
develop_cells = each(lambda cell, cfa, area, *levels: developed(mosaic(cell), cfa, tuple(area), *levels), "rgba")


def downscale_cells(column: pa.Array, longest: int) -> pa.Array:
    return each(lambda cell: shrunk(rgba(cell), longest), "rgba")(column)


def normalize_cfa(image: Column, black: Column, white: Column) -> Column:
    """STRUCT(width, height, values: little-endian float32) of STRUCT(width, height, cfa)."""
    work = each(lambda cell, lo, hi: normalized(mosaic(cell), lo, hi), "values")

    @F.arrow_udf(PLANE)
    def run(im: pa.Array, b: pa.Array, w: pa.Array) -> pa.Array:
        return work(im, b, w)

    return run(image, black, white)


def plane_values(plane: Column) -> Column:
    """ARRAY<FLOAT> of a plane's values, row by row."""

    @F.arrow_udf("array<float>")
    def run(p: pa.Array) -> pa.Array:
        return pa.array([None if cell is None else cell[2].view("<f4") for cell in images(p)], pa.list_(pa.float32()))

    return run(plane)


def superpixels(plane: Column, cfa: Column, area: Column) -> Column:
    """Half-size RGB plane of a scaled Bayer plane: a pixel for each 2x2 quad of ``area``
    (ARRAY(x, y, w, h)), its green the mean of both; an unknown pattern gives null."""

    def join(cell: tuple, name: str, at: list) -> np.ndarray | None:
        return superpixel(floats(cell), name, tuple(at)).astype("<f4", copy=False) if shifted(name, at[0], at[1]) in QUADS else None

    @F.arrow_udf(PLANE)
    def run(p: pa.Array, c: pa.Array, a: pa.Array) -> pa.Array:
        return each(join, "values")(p, c, a)

    return run(plane, cfa, area)


def calibrate(rgb: Column, gains: Column, matrix: Column) -> Column:
    """RGB plane from camera colours to linear sRGB (see ``calibrated``)."""

    @F.arrow_udf(PLANE)
    def run(p: pa.Array, g: pa.Array, m: pa.Array) -> pa.Array:
        return each(lambda cell, gain, mat: calibrated(floats(cell, 3), gain, mat).astype("<f4", copy=False), "values")(p, g, m)

    return run(rgb, gains, matrix)


def pack_rgba(rgb: Column) -> Column:
    """Opaque 8-bit image of a linear RGB plane, by the tone curve."""

    @F.arrow_udf(IMAGE)
    def run(p: pa.Array) -> pa.Array:
        return each(lambda cell: packed(floats(cell, 3)), "rgba")(p)

    return run(rgb)


def develop_browse(image: Column, cfa: Column, area: Column, black: Column, white: Column, gains: Column, matrix: Column) -> Column:
    """Half-size opaque RGBA of a Bayer mosaic: scale, join quads, calibrate, tone.
    ``area`` is ARRAY(x, y, w, h); an unknown pattern gives null."""

    @F.arrow_udf(IMAGE)
    def run(im: pa.Array, c: pa.Array, a: pa.Array, b: pa.Array, w: pa.Array, g: pa.Array, m: pa.Array) -> pa.Array:
        return develop_cells(im, c, a, b, w, g, m)

    return run(image, cfa, area, black, white, gains, matrix)


def rotate(image: Column, orientation: Column) -> Column:
    @F.arrow_udf(IMAGE)
    def run(im: pa.Array, o: pa.Array) -> pa.Array:
        return rotate_cells(im, o)

    return run(image, orientation)


def downscale(image: Column, longest: int) -> Column:
    @F.arrow_udf(IMAGE)
    def run(im: pa.Array) -> pa.Array:
        return downscale_cells(im, longest)

    return run(image)


def validate_pixels(image: Column) -> Column:
    """STRUCT(valid, opaque): the bytes fit the size; every alpha is 255 (null if not valid)."""

    @F.arrow_udf("valid boolean, opaque boolean")
    def run(im: pa.Array) -> pa.Array:
        out = []
        for cell in images(im):
            valid = None if cell is None else len(cell[2]) == cell[0] * cell[1] * 4
            out.append({"valid": valid, "opaque": bool((cell[2][3::4] == 255).all()) if valid else None})
        return pa.array(out, pa.struct([("valid", pa.bool_()), ("opaque", pa.bool_())]))

    return run(image)


def _steps(image: np.ndarray) -> np.ndarray:
    return np.diff(image[..., :3].astype(np.int16), axis=1)


def image_error_metrics(source: Column, decoded: Column) -> Column:
    """STRUCT(psnr, max_error) over RGB; equal images have an infinite PSNR."""

    def compare(a: np.ndarray, b: np.ndarray) -> dict:
        squares, most = 0, 0
        for i in range(0, len(a), BAND):
            e = a[i : i + BAND, :, :3].astype(np.int32) - b[i : i + BAND, :, :3]
            squares, most = squares + int((e * e).sum(dtype=np.int64)), max(most, int(np.abs(e).max()))
        mse = squares / (a.shape[0] * a.shape[1] * 3)
        return {"psnr": math.inf if mse == 0 else 10 * math.log10(255**2 / mse), "max_error": most}

    @F.arrow_udf("psnr double, max_error int")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = [None if x is None or y is None else compare(rgba(x), rgba(y)) for x, y in zip(images(a), images(b))]
        return pa.array(out, pa.struct([("psnr", pa.float64()), ("max_error", pa.int32())]))

    return run(source, decoded)


def neighbor_delta_mae(source: Column, decoded: Column) -> Column:
    """Mean absolute difference of both images' steps from pixel to pixel along rows."""

    def compare(a: np.ndarray, b: np.ndarray) -> float:
        total = sum(int(np.abs(_steps(a[i : i + BAND]) - _steps(b[i : i + BAND])).sum(dtype=np.int64)) for i in range(0, len(a), BAND))
        return total / max(1, a.shape[0] * (a.shape[1] - 1) * 3)

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else compare(rgba(x), rgba(y)) for x, y in zip(images(a), images(b))], pa.float64())

    return run(source, decoded)


#: Fixed values of the format: start-of-frame markers, and markers without a length.
FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
BARE = {0x01, *range(0xD0, 0xD8)}
#: A marker: any number of fill bytes, and its code.
MARKER = re.compile(rb"\xff+([^\xff])", re.DOTALL)


def jpeg_segments(data: bytes) -> dict[int, bytes]:
    """The first payload of each marker in a JPEG's header, up to the picture's data."""
    found: dict[int, bytes] = {}
    if not data.startswith(b"\xff\xd8"):
        raise ValueError("no start of image")
    at = 2
    while m := MARKER.match(data, at):
        code, at = m[1][0], m.end()
        if code in (0xD9, 0xDA):
            return found
        if code not in BARE:
            payload = data[at + 2 : at + int.from_bytes(data[at : at + 2], "big")]
            at += 2 + len(payload)
            if int.from_bytes(data[at - 2 - len(payload) : at - len(payload)], "big") != 2 + len(payload):
                raise ValueError("a segment's length doesn't fit")
            found.setdefault(code, payload)
            if code in FRAMES:
                return found
    raise ValueError("the header is cut")


def sampling_of(data: bytes) -> tuple[str | None, str | None]:
    """('4:4:4' or 'other', None) from a JPEG's frame header, or (None, what is wrong)."""
    try:
        frames = [payload for code, payload in jpeg_segments(data).items() if code in FRAMES]
    except ValueError as error:
        return None, str(error)
    if not frames or len(frames[0]) < 9:
        return None, "no whole frame header"
    # Six bytes, the last one the number of components, then three bytes for each: its id, factors and table.
    count, factors = frames[0][5], frames[0][7::3]
    return ("4:4:4" if count == 3 and factors[:3] == b"\x11" * 3 else "other"), None


def jpeg_sampling(data: Column) -> Column:
    @F.arrow_udf("sampling string, error string")
    def run(x: pa.Array) -> pa.Array:
        found = [(None, "no data") if v is None else sampling_of(v.tobytes()) for v in cells(x)]
        return pa.StructArray.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], names=["sampling", "error"])

    return run(data)
