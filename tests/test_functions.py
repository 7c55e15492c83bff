from conftest import rows
from pyspark.sql import functions as F

from curalake.functions import geometry, hashing, text
from curalake.functions.probability import argmax, softmax
from curalake.operators.images import _orientation


def one(spark, *columns):
    return spark.sql("SELECT 1").select(*columns).first()


def test_hex_rules_and_hamming(spark):
    assert tuple(one(
        spark, hashing.is_hex(F.lit("ab"), 2), hashing.is_hex(F.lit("ab\n"), 2), hashing.is_hex(F.lit(None).cast("string"), 2),
        hashing.hex_hamming(F.lit("ffffffffffffffff"), F.lit("0000000000000001")), hashing.hex_hamming(F.lit("ff"), F.lit("f")),
        hashing.hex64(hashing.hash64(F.lit("F00000000000000A"))),
    )) == (True, False, False, 63, None, "f00000000000000a")


def test_difference_hash_is_least_significant_bit_first(spark):
    rising, grid = [0.0] * 72, [0.0] * 72
    grid[1] = 5.0  # only pixel 1 > pixel 0: bit 0
    for row in range(8):
        for column in range(9):
            rising[row * 9 + column] = float(column)
    df = spark.createDataFrame([(grid,), (rising,), ([1.0] * 72,)], "grid array<double>")
    found = [r[0] for r in df.select(hashing.grid_difference_hash(F.col("grid"))).collect()]
    assert found == ["0000000000000001", "f" * 16, "0" * 16]


def test_text(spark):
    df = spark.createDataFrame([("&lt;b&gt;A&lt;/b&gt;  B",), ("x \n<i>y</i> &amp; z",), (None,)], "h string")
    assert [r[0] for r in df.select(text.plain_text(F.col("h"))).collect()] == ["A B", "x y & z", None]
    found = one(
        spark, text.safe_name(F.lit(" a b/c "), F.lit("p/q.jpg")), text.safe_name(F.lit(""), F.lit("p/q.jpg")),
        text.image_path(F.lit("x/ann/y/ann/z.jpg.json")), text.image_path(F.lit("x/z.json")),
        text.quoted(F.lit("a b/c*~é")), text.title_case(F.lit("on_order-now it's")), text.availability_label(F.lit(" LOW_stock ")),
        text.file_size_label(F.lit(1023)), text.file_size_label(F.lit(1536)), text.file_size_label(F.lit(3 * 1024 * 1024)),
    )
    assert tuple(found) == (
        "a_b_c__q.jpg", "q.jpg", "x/img/y/ann/z.jpg", None, "a%20b/c%2A~%C3%A9", "On Order-Now It'S", "Low stock", "1023 B", "1.5 KB", "3.0 MB",
    )


def test_geometry(spark):
    box = geometry.box(F.lit(200), F.lit(150), F.lit(400), F.lit(350))
    crop = one(spark, geometry.square_crop(box, F.lit(800), F.lit(600)).alias("c"))["c"]
    assert tuple(crop) == (160, 110, 440, 390)
    flat = geometry.box(F.lit(1), F.lit(1), F.lit(1), F.lit(5))
    found = one(
        spark, geometry.covered_fraction(flat, box), geometry.covered_fraction(box, box), geometry.area(flat),
        geometry.square_crop(box, F.lit(90), F.lit(600)).isNull(),
        geometry.crop_json(geometry.scaled_crop(geometry.box(F.lit(1), F.lit(3), F.lit(5), F.lit(9), "int"), F.lit(10), F.lit(10), F.lit(5), F.lit(5))),
    )
    assert tuple(found) == (1.0, 1.0, 0.0, True, "[0,2,2,4]")  # 0.5, 1.5, 2.5 round half to even


def test_softmax(spark):
    df = spark.createDataFrame([([1000.0, 1000.0, 0.0, 0.0],), ([0.0, 0.0, 0.0, 0.0],)], "z array<double>")
    found = df.select(softmax(F.col("z")).alias("p")).select(argmax(F.col("p")), F.array_max("p")).collect()
    assert [tuple(r) for r in found] == [(0, 0.5), (0, 0.25)]


def test_exif_orientation():
    entry = (274).to_bytes(2, "big") + (3).to_bytes(2, "big") + (1).to_bytes(4, "big") + (6).to_bytes(2, "big") + b"\0\0"
    tiff = b"MM\0*" + (8).to_bytes(4, "big") + (1).to_bytes(2, "big") + entry
    body = b"Exif\0\0" + tiff
    jpeg = b"\xff\xd8\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body + b"\xff\xda"
    assert _orientation(jpeg) == 6 and _orientation(b"\xff\xd8\xff\xda") == 1 and _orientation(b"") == 1


def test_row_digest_keeps_cells_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "-1:")], "x string, y string")
    assert len({r[0] for r in df.select(hashing.row_digest(F.col("x"), F.col("y"))).collect()}) == 3
    assert rows(df.select(hashing.stable_id(F.lit("dent"), F.lit("0123456789abcdef99")))) == [("dent-0123456789abcdef",)] * 3


def test_strip_takes_all_white_space(spark):
    df = spark.createDataFrame([("\t accepted\n",), ("\x1c x \x85",), ("\t",), (None,)], "s string")
    assert [r[0] for r in df.select(text.strip(F.col("s"))).collect()] == ["accepted", "x", "", None]
    assert [r[0] for r in df.select(text.is_blank(F.col("s"))).collect()] == [False, False, True, True]
    assert df.select(text.folded(F.col("s"))).first()[0] == "accepted"
