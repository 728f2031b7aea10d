import os
import struct
import sys
import zlib

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


def png(pixels) -> bytes:
    """An 8-bit RGB (or gray) PNG of nested lists of pixels."""
    height, width = len(pixels), len(pixels[0])
    gray = not isinstance(pixels[0][0], (tuple, list))
    raw = b"".join(b"\0" + bytes(v for px in row for v in ([px] if gray else px)) for row in pixels)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 0 if gray else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture(scope="session")
def image_dir(tmp_path_factory):
    """Images and masks of known pixels, a corrupt file, odd names."""
    root = tmp_path_factory.mktemp("data")
    images, masks = root / "images", root / "masks"
    (images / "sub").mkdir(parents=True)
    (masks / "sub").mkdir(parents=True)
    red, green, blue, mix = (255, 0, 0), (0, 255, 0), (0, 0, 255), (10, 20, 30)
    (images / "IMG_1.png").write_bytes(png([[red, green], [blue, mix]]))
    (images / "IMG_2.PNG").write_bytes(png([[mix, mix, red], [mix, mix, blue]]))
    (images / "IMG_3.png").write_bytes(b"not an image")
    (images / "notes.txt").write_text("x")
    (images / "sub" / "IMG_4.png").write_bytes(png([[red]]))
    (masks / "IMG_1_segmentation.png").write_bytes(png([[0, 255], [3, 0]]))
    (masks / "IMG_2-seg.png").write_bytes(png([[0, 9], [0, 0]]))
    (masks / "mask_IMG_4.png").write_bytes(png([[1]]))
    (masks / "sub" / "IMG_1_segmentation.png").write_bytes(png([[0]]))
    return root
