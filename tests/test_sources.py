import numpy as np
import pytest

from pixelloom.codecs import jpeg, raster, registry
from pixelloom.operators import signal
from pixelloom.sources import datasource, images
from pixelloom.streaming import frames

from . import fixtures as fx


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("images")
    p = fx.picture(9, 13)
    (d / "a.png").write_bytes(fx.png(p, 2, filters=[4, 3]))
    (d / "b.bmp").write_bytes(raster.bmp_encode(p))
    (d / "c.jpg").write_bytes(jpeg.jpeg_encode(p, 90))
    (d / "d.gif").write_bytes(fx.gif([p[:, :, 0], p[:, :, 1]], np.arange(768, dtype=np.uint8).reshape(256, 3)))
    (d / "e.tif").write_bytes(fx.tiff(p, compression=5))
    (d / "f.heic").write_bytes(fx.heif())
    (d / "g.bin").write_bytes(b"junk")
    (d / "h.png").write_bytes(b"\x89PNG\r\n\x1a\n\0\0")
    (d / "i.empty").write_bytes(b"")
    return d


def test_metadata_pixels_chunks_boxes(spark, folder):
    content = images.files(spark, str(folder))
    meta = {r.path.rsplit("/", 1)[1]: r for r in images.metadata(content).collect()}
    assert {k: (r.format, r.width, r.height) for k, r in meta.items() if r.error is None} == {"a.png": ("png", 13, 9), "b.bmp": ("bmp", 13, 9), "c.jpg": ("jpeg", 13, 9), "d.gif": ("gif", 13, 9), "e.tif": ("tiff", 13, 9), "f.heic": ("heif", 64, 48)}
    assert meta["g.bin"].error and meta["h.png"].error and "i.empty" not in meta  # Spark lists no empty files
    pix = images.pixels(content)
    rows = {(r.path.rsplit("/", 1)[1], r.frame_idx): r for r in pix.collect()}
    assert rows["d.gif", 1].delay_cs == 10 and rows["f.heic", 0].error
    assert rows["a.png", 0].data == fx.picture(9, 13)[:, :, ::-1].tobytes()
    assert images.pixels(content, most_frames=1).where("path LIKE '%d.gif'").count() == 1
    assert images.chunks(content).where("path LIKE '%a.png'").orderBy("idx").first().type == "IHDR"
    assert images.boxes(content).where("type = 'ispe'").first().fields["width"] == "64"
    one = images.explode_pixels(pix.where("path LIKE '%a.png'"))
    assert one.count() == 9 * 13 and one.where("y = 2 AND x = 3").first().b == int(fx.picture(9, 13)[2, 3, 2])


def test_same_pixels_as_the_image_source(spark, folder):
    native = {r.image.origin.rsplit("/", 1)[1]: r.image for r in spark.read.format("image").option("dropInvalid", True).load(str(folder)).collect()}
    ours = {r.path.rsplit("/", 1)[1]: r for r in images.pixels(images.files(spark, str(folder))).where("frame_idx = 0 AND error IS NULL").collect()}
    for name in ("a.png", "e.tif"):
        assert bytes(native[name].data) == ours[name].data
    a, b = (np.frombuffer(bytes(x), np.uint8).astype(int) for x in (native["c.jpg"].data, ours["c.jpg"].data))
    # Chroma is enlarged by another filter there: equal up to that.
    assert a.size == b.size and np.abs(a - b).mean() < 8


def test_progressive_jpeg_from_the_jvm(spark):
    jvm = spark.sparkContext._jvm
    p = np.dstack([np.add.outer(np.arange(40) * 3, np.arange(56) * 2) % 256] * 3).astype(np.uint8)
    image = jvm.java.awt.image.BufferedImage(56, 40, 5)
    for y in range(40):
        for x in range(56):
            v = int(p[y, x, 0])
            image.setRGB(x, y, v << 16 | v << 8 | v)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    for progressive in (False, True):
        params = writer.getDefaultWriteParam()
        if progressive:
            params.setProgressiveMode(1)
        out = jvm.java.io.ByteArrayOutputStream()
        stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
        writer.setOutput(stream)
        writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), params)
        stream.flush()
        data = bytes(out.toByteArray())
        assert registry.info(data).extra["process"] == ("progressive" if progressive else "baseline")
        assert np.abs(registry.decode(data)[0].pixels.astype(int) - p).mean() < 4
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(jpeg.jpeg_encode(p, 95)))
    got = np.array([[back.getRGB(x, y) & 255 for x in range(0, 56, 7)] for y in range(0, 40, 5)])
    assert np.abs(got - p[::5, ::7, 0]).max() < 8


def test_transcode_and_data_sources(spark, folder, tmp_path):
    datasource.register(spark)
    meta = spark.read.format("imgmeta").option("filesPerPartition", "2").load(str(folder))
    assert meta.where("format = 'png' AND error IS NULL").count() == 1 and meta.count() == 9
    made = images.encoded(images.pixels(images.files(spark, str(folder))).where("error IS NULL"), "BMP")
    named = made.selectExpr("concat(regexp_extract(path, '([^/]+)$', 1), '-', frame_idx, '.bmp') AS name", "content")
    named.write.format("imgfile").mode("append").save(str(tmp_path / "out"))
    assert np.array_equal(registry.decode((tmp_path / "out" / "a.png-0.bmp").read_bytes())[0].pixels[:, :, :3], fx.picture(9, 13)[:, :, ::-1])
    with pytest.raises(ValueError):
        images.encoded(made, "nothing")
    assert images.encoded(images.pixels(images.files(spark, str(folder), "a.png")), "gif").first().error


def test_best_icon(spark, tmp_path):
    (tmp_path / "x.ico").write_bytes(fx.ico([(fx.picture(4, 4), np.zeros((4, 4), np.uint8)), (fx.picture(4, 9), np.zeros((4, 9), np.uint8))]))
    assert images.best_icons(images.files(spark, str(tmp_path))).first().width == 9


def test_streams(spark, folder, tmp_path):
    got = []
    frames.consume(frames.metadata_stream(spark, str(folder), 3), str(tmp_path / "c"), lambda df, n: got.extend(r.format for r in df.collect())).awaitTermination(120)
    assert len(got) == 8 and got.count("png") == 2
    src = tmp_path / "events"
    spark.createDataFrame([(1, 1, 5), (1, 2, 9), (2, 1, 3)], "k int, t int, v long").coalesce(1).write.json(str(src))
    stream = spark.readStream.schema("k int, t int, v long").json(str(src))
    out = []
    frames.consume(frames.running_differences(stream, "k", "t", "v"), str(tmp_path / "d"), lambda df, n: out.extend(map(tuple, df.collect()))).awaitTermination(180)
    assert sorted(out) == [(1, 1, 5), (1, 2, 4), (2, 1, 3)]


def test_huffman_tables_decode(spark):
    text = "abracadabra"
    counts = spark.createDataFrame([("g", b, text.encode().count(b)) for b in set(text.encode())], "g string, b int, n long")
    codes = signal.canonical_codes(signal.huffman_lengths(counts, "g"), "g").collect()
    words = {format(r.code, f"0{r.len}b"): r.b for r in codes}
    bits = "".join(next(w for w, b in words.items() if b == c) for c in text.encode())
    out, now = bytearray(), ""
    for bit in bits:
        now += bit
        if now in words:
            out.append(words[now])
            now = ""
    assert bytes(out) == text.encode() and len(bits) == 23
