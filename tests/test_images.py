import struct
import zlib

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from curalake.functions.hashing import grid_difference_hash
from curalake.operators import images as I
from curalake.sources import tables


def png(pixels):
    height, width, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(height))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png_folder(spark, tmp_path):
    rising = np.zeros((10, 20, 3)) + np.arange(20)[None, :, None] * 10
    (tmp_path / "rising.png").write_bytes(png(rising))
    (tmp_path / "tall.png").write_bytes(png(np.full((30, 12, 3), 40)))
    (tmp_path / "broken.png").write_bytes(png(rising)[:40])
    scanned = tables.scan_images(spark, str(tmp_path))
    audit = {r["path"].rsplit("/", 1)[-1]: r for r in I.decode_audit(scanned).collect()}
    assert (audit["rising.png"]["short_side"], audit["tall.png"]["short_side"], audit["broken.png"]["decodable"]) == (10, 12, False)
    named = scanned.select(F.element_at(F.split("image.origin", "/"), -1).alias("name"), "image")
    hashes = dict(rows(I.image_grids(named).select("name", grid_difference_hash(F.col("grid")))))
    assert hashes["rising.png"] == "f" * 16 and hashes["tall.png"] == "0" * 16 and hashes["broken.png"] is None
    ranges = dict(rows(I.image_luma_range(named)))
    assert ranges["tall.png"] == 0 and ranges["rising.png"] > 150
    features = dict(rows(I.image_features(named, 8)))
    assert len(features["rising.png"]) == 3 * 8 * 8 and features["broken.png"] is None
    content = tables.scan_content(spark, str(tmp_path), "*.png")
    import hashlib

    expected = hashlib.sha256((tmp_path / "tall.png").read_bytes()).hexdigest()
    assert rows(content.filter("path LIKE '%tall.png'"), "actual_checksum") == [(expected,)]
    assert tables.list_files(spark, str(tmp_path), "*.png").count() == 3


def test_square_pad_puts_the_odd_pixel_right_and_below():
    image = np.zeros((2, 5, 3))
    padded = I.square_pad(image)
    assert padded.shape == (5, 5, 3) and tuple(padded[0, 0]) == (124, 116, 104) and padded[1, 0, 0] == 0 and padded[2, 0, 0] == 0 and padded[3, 0, 0] == 124
    same = I.resize(np.arange(27.0).reshape(3, 3, 3), 3, 3)
    assert np.allclose(same, np.arange(27.0).reshape(3, 3, 3))


def test_weights_of_long_sides_are_not_kept():
    for height in range(2000, 2040):
        assert I.resample_weights(height, 64, 1.0, I.triangle).shape == (64, height)
    I.resample_weights(10, 9, 3.0, I.lanczos)
    kept = I._kept_weights.cache_info()
    assert kept.maxsize * 64 * I.KEPT_SIDE * 8 < 1 << 26 and kept.currsize < 40


def test_image_batches_are_bounded(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        I.image_luma_range(spark.createDataFrame([], "doc_id bigint, image struct<height:int,width:int,nChannels:int,data:binary>"))
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
