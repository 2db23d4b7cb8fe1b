"""Report photos: which are usable, and their perceptual hashes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import constants as C
from tidewatch.sources.storage import stored


def is_remote(url: Column) -> Column:
    """Remote links are never fetched."""
    return F.coalesce(url.contains("://"), F.lit(False))


def _filesystem(root: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a root (a local path or a URI) and the path in it."""
    if "://" not in root or root.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(root)


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """path (below ``root``), length of every file there, those of no bytes too, which Spark's readers pass over.

    Folders are listed in tasks, a level of the tree at a time: a task lists whole folders. What is on the
    driver is the list of folders of a level only.
    """
    below, found = [""], None

    def listed(batches):
        fs, base = _filesystem(root)
        for batch in batches:
            for at in batch.column(0).to_pylist():
                infos = [i for i in fs.get_file_info(pafs.FileSelector(f"{base}/{at}".rstrip("/"))) if not i.base_name.startswith((".", "_"))]
                columns = [[f"{at}/{i.base_name}".lstrip("/") for i in infos], [i.size or 0 for i in infos], [i.type == pafs.FileType.Directory for i in infos]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.bool_()))], names=["path", "length", "folder"])

    while below:
        folders = spark.createDataFrame([(p,) for p in below], "path string").repartition(min(len(below), 4 * spark.sparkContext.defaultParallelism))
        level = stored(folders.mapInArrow(listed, "path string, length long, folder boolean"), "listing")
        files = level.filter("NOT folder").select("path", "length")
        found = files if found is None else found.unionByName(files)
        below = [r["path"] for r in level.filter("folder").select("path").toLocalIterator()]
    return found


def _below(c: Column, root: str) -> Column:
    """A file's path below the root, whatever scheme it is written with; the readers' paths may be encoded."""
    plain = root.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    return F.substring(c, F.locate(plain, c) + len(plain), F.length(c))


def media_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path (below ``path``), name, length, reason: all files there and why one is not accepted (null: accepted).

    What the JVM's image reader can't decode, webp among it, is ``undecodable``. Files are told apart by
    their whole path. Hidden files (``.`` or ``_`` in front) are passed over, as Spark's readers do.
    """
    seen = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select(F.col("image.origin").alias("origin"))
    decoded = seen.select(_below(F.try_url_decode(F.regexp_replace("origin", "\\+", "%2B")), path).alias("path"), F.lit(True).alias("decoded"))
    met = _listed(spark, path.rstrip("/")).join(decoded, "path", "left").withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))
    kind = F.lower(F.regexp_extract("name", "\\.([^.]+)$", 1))
    reason = (
        F.when(~kind.isin(C.MEDIA_EXTENSIONS), "unsupported type")
        .when(F.col("length") == 0, "empty file")
        .when(F.col("length") > C.MEDIA_MAX_BYTES, "too large")
        .when(F.col("decoded").isNull(), "undecodable")
    )
    return met.select("path", "name", "length", reason.alias("reason"))


_DCT = np.array([[math.cos(math.pi * k * (2 * n + 1) / 64) for n in range(32)] for k in range(8)])


def phash(grey: np.ndarray) -> str:
    """64-bit hash of a grey image: 32 x 32 means, low 8 x 8 cosine terms against their median."""
    def shrink(m):
        edges = np.linspace(0, m.shape[0], 33)
        sums = np.vstack([np.zeros(m.shape[1]), np.cumsum(m, axis=0)])
        at = np.array([np.interp(edges, np.arange(len(sums)), sums[:, k]) for k in range(m.shape[1])]).T
        return np.diff(at, axis=0) / np.diff(edges)[:, None]

    small = shrink(shrink(grey.astype(np.float64)).T).T
    low = _DCT @ small @ _DCT.T
    bits = (low > np.median(low)).reshape(-1)
    return "".join(f"{int(''.join('1' if b else '0' for b in bits[k : k + 4]), 2):x}" for k in range(0, 64, 4))


def _exif(file) -> bytes:
    """The EXIF block of a JPEG or PNG file (empty: none); reads headers only and seeks over the rest."""
    start = file.read(8)
    if start[:2] == b"\xff\xd8":
        file.seek(2)
        while len(head := file.read(4)) == 4 and head[0] == 0xFF:
            if head[1] == 0xFF:  # filling
                file.seek(file.tell() - 3)
                continue
            size = int.from_bytes(head[2:], "big") - 2
            if head[1] in (0xD9, 0xDA) or size < 0:  # the picture begins, or nothing follows
                break
            if head[1] == 0xE1 and (body := file.read(size))[:6] == b"Exif\0\0":
                return body[6:]
            if head[1] != 0xE1:
                file.seek(file.tell() + size)
    elif start == b"\x89PNG\r\n\x1a\n":
        while len(head := file.read(8)) == 8 and head[4:] != b"IEND":
            size = int.from_bytes(head[:4], "big")
            if head[4:] == b"eXIf":
                return file.read(size)
            file.seek(file.tell() + size + 4)
    return b""


def orientation(exif: bytes) -> int:
    """The orientation, 1 to 8, that an EXIF block gives; 1 where it gives none or is damaged."""
    order = {b"II": "little", b"MM": "big"}.get(exif[:2])
    if order is None:
        return 1
    number = lambda at, size: int.from_bytes(exif[at : at + size], order)
    table = number(4, 4)
    for at in range(table + 2, min(table + 2 + 12 * number(table, 2), len(exif) - 11), 12):
        if number(at, 2) == 0x0112 and number(at + 2, 2) == 3:
            return number(at + 8, 2) if 1 <= number(at + 8, 2) <= 8 else 1
    return 1


def upright(pixels: np.ndarray, turn: int) -> np.ndarray:
    """The picture as it is meant to be seen: what its orientation says is undone."""
    if turn >= 5:
        pixels = pixels.swapaxes(0, 1)
    # What is left after rows and columns are exchanged is a mirror of one or both.
    if turn in (3, 4, 7, 8):
        pixels = pixels[::-1]
    if turn in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    return pixels


def phash_images(spark: SparkSession, path: str) -> DataFrame:
    """path (below ``path``), name, phash of every decodable image there, turned as its EXIF orientation says.

    The JVM decodes pixels without turning them, so tasks read the header of each file once more.
    """
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    at = _below(F.try_url_decode(F.regexp_replace("image.origin", "\\+", "%2B")), path)
    pixels = images.select(at.alias("path"), "image.height", "image.width", "image.nChannels", "image.data")

    def hashed(batches):
        fs, base = _filesystem(path.rstrip("/"))
        for batch in batches:
            paths, hashes = [], []
            for r in batch.to_pylist():
                cube = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"]).astype(np.float64)
                # Stored as blue, green, red.
                grey = cube[:, :, 0] if r["nChannels"] == 1 else cube[:, :, :3] @ np.array([0.114, 0.587, 0.299])
                with fs.open_input_file(f"{base}/{r['path']}") as file:
                    turn = orientation(_exif(file))
                paths.append(r["path"])
                hashes.append(phash(upright(grey, turn)))
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(hashes)], names=["path", "phash"])

    return pixels.mapInArrow(hashed, "path string, phash string").select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "phash")
