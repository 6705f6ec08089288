"""Operators against plain Python and by their defined edge cases."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from vellumetry.functions import raster, strings
from vellumetry.operators import compile as compiling
from vellumetry.operators import edits, merge, regions, split, template, text
from vellumetry.operators.nested import children_with_parents, flat_tables, nodes, nodes_of
from vellumetry.plans import detect, importing
from vellumetry.sources import images, projects

BOX = "page_id bigint, slot bigint, rtype string, confidence double, source string, col_no int, x double, y double, w double, h double"


def boxes(spark, rows):
    return spark.createDataFrame(rows, BOX)


def box(slot, x, y, w, h, rtype="body", sure=0.8, page=1, col=0):
    return (page, slot, rtype, sure, "detected", col, float(x), float(y), float(w), float(h))


# ------------------------------------------------------------------ splitting


def test_route_by_shape(spark):
    rows = spark.createDataFrame([("a", 1000, 1000, 5, "r"), ("b", 1100, 1000, 5, "r"), ("c", None, 10, 5, "r"), ("d", 10, 0, 5, "r")], "id string, image_w int, image_h int, spine_x int, right_path string")
    got = {r.id: (r.is_single, r.spine_x, r.right_path) for r in split.route(rows).collect()}
    assert got == {"a": (True, 1000, None), "b": (False, 5, "r"), "c": (None, 5, "r"), "d": (None, 5, "r")}


@pytest.mark.parametrize("width", [64, 101, 400])
def test_spine_like_numpy(spark, width):
    rng = np.random.default_rng(width)
    pages = {}
    for i in range(6):
        p = rng.uniform(150, 250, width)
        if i % 2:
            at = int(width * rng.uniform(0.4, 0.6))
            p[max(0, at - width // 20) : at + width // 20] = 20
        pages[i] = p
    rows = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in pages.items()], "id bigint, v array<double>")
    got = {r.id: (r.spine_x, r.method) for r in split.spines(split.profile_rows(rows, "id", "v")).collect()}
    for i, p in pages.items():
        s = np.convolve(p, np.ones(20) / 20, mode="same")
        lo, hi = int(0.35 * width), int(0.65 * width)
        deep = (s.mean() - s[lo:hi].min()) / (s.mean() + 1e-6) >= 0.08
        at = lo + int(np.round(s[lo:hi], 9).argmin()) if deep else width // 2
        assert got[i] == (max(int(0.15 * width), min(int(0.85 * width), at)), "detected" if deep else "centre")


# ------------------------------------------------------------------ regions


def test_types_at_their_limits(spark):
    rows = [box(1, 0, 0.19, 0.21, 0.07), box(2, 0, 0.20, 0.21, 0.07), box(3, 0, 0.19, 0.20, 0.07), box(4, 0, 0.91, 0.29, 0.05), box(5, 0, 0.90, 0.29, 0.05)]
    got = {r.slot: r.rtype for r in regions.classified(boxes(spark, rows).withColumn("td", F.lit(0.031))).collect()}
    assert got == {1: "header", 2: "body", 3: "pagenum", 4: "pagenum", 5: "body"}


def test_overlap_merge_is_seeded_not_transitive():
    a, b, c = ({"slot": i, "x": 0.0, "y": y, "w": 1.0, "h": 0.2, "rtype": "body", "confidence": s} for i, y, s in ((1, 0.0, 0.5), (2, 0.1, 0.9), (3, 0.2, 0.9)))
    got = merge.merge_overlaps([c, b, a])
    assert [(g["slot"], round(g["y"], 3), round(g["h"], 3), round(g["confidence"], 3)) for g in got] == [(2, 0.0, 0.3, 0.81), (3, 0.2, 0.2, 0.9)]


def test_merges_on_pages_of_any_kind(spark):
    rows = [box(1, 0, 0.0, 0.5, 0.1), box(2, 0, 0.15, 0.5, 0.1), box(3, 0.6, 0.2, 0.3, 0.1, page=2), box(1, 0, 0, 1, 1, "header", page=3)]
    assert merge.overlaps_merged(boxes(spark, rows)).count() == 4
    assert merge.adjacent_merged(boxes(spark, rows)).where("page_id = 1").collect()[0].h == pytest.approx(0.25)
    assert merge.adjacent_merged(boxes(spark, rows), "newlines").count() == 4
    assert merge.adjacent_merged(boxes(spark, [])).count() == 0


def test_adjacent_merge_keeps_columns_apart_unless_told():
    left = {"slot": 1, "x": 0.0, "y": 0.0, "w": 0.4, "h": 0.1, "rtype": "body", "confidence": 0.5, "col_no": 1}
    rest = [{**left, "slot": 2, "y": 0.12}, {**left, "slot": 3, "y": 0.24, "col_no": 2}]
    assert len(merge.merge_adjacent([left, *rest], 0.1)) == 2
    again = [{**rest[1], "col_no": 0}]
    assert len(merge.merge_adjacent([left, rest[0], *again], 0.1, reset_column=True)) == 1


def test_overlapping_boxes_are_not_adjacent():
    a = {"slot": 1, "x": 0.0, "y": 0.0, "w": 1.0, "h": 0.2, "rtype": "body", "confidence": 0.5, "col_no": 0}
    assert len(merge.merge_adjacent([a, {**a, "slot": 2, "y": 0.1}], 0.1)) == 2


def test_template_blend():
    found = [{"slot": 1, "x": 0.0, "y": 0.0, "w": 1.0, "h": 0.2, "rtype": "body", "confidence": 0.9, "source": "detected"}]
    due = [{**found[0], "slot": 2, "rtype": "header", "confidence": 0.8}, {**found[0], "slot": 3, "confidence": 0.8}, {**found[0], "slot": 4, "y": 0.8, "confidence": None}]
    got = merge.blend_template(found, due)
    assert [(g["source"], round(g["confidence"], 4)) for g in got] == [("detected+template", 0.98), ("template", 0.68), ("template", 0.595)]


def test_reading_order_by_columns_only_with_two(spark):
    rows = [box(1, 0.6, 0.1, 0.3, 0.1, col=2), box(2, 0.0, 0.5, 0.3, 0.1, col=1), box(3, 0, 0.0, 1, 0.05, "header"), box(4, 0, 0.9, 1, 0.05, "pagenum"), box(5, 0, 0.3, 1, 0.1, "footnote")]
    order = lambda d: [r.slot for r in regions.reading_order(d).orderBy("ord").collect()]
    assert order(boxes(spark, rows)) == [3, 2, 1, 5, 4]
    assert order(boxes(spark, rows).withColumn("col_no", F.lit(None).cast("int"))) == [3, 1, 2, 5, 4]


def test_pipeline_from_an_image(spark, tmp_path):
    page = np.full((600, 420, 3), 235, np.uint8)
    rng = np.random.default_rng(1)
    for y in range(150, 420, 12):
        page[y : y + 7, 60:360] = rng.integers(0, 255, (7, 300, 1))
    (tmp_path / "a.png").write_bytes(images.png(page))
    (tmp_path / "bad.png").write_bytes(b"no image")
    read = images.read_images(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[-1]: r.error for r in read.select("path", "error").collect()} == {"a.png": None, "bad.png": "cannot read image"}
    found = detect.candidate_boxes(read, denoised=False).withColumn("page_id", F.lit(1).cast("bigint"))
    got = detect.detect(found).collect()
    assert got and max(r.h for r in got) > 0.3 and {r.rtype for r in got} <= {"body", "header", "pagenum", "unknown"}


def scans(tmp_path):
    """A spread with a dark spine, a single page, and a file that is no image."""
    src = tmp_path / "scans"
    src.mkdir()
    spread = np.full((200, 400, 3), 230, np.uint8)
    spread[:, 214:226] = 10
    spread[40:60, 40:160] = 0
    (src / "b.png").write_bytes(images.png(spread))
    (src / "a.png").write_bytes(images.png(np.full((300, 200, 3), 240, np.uint8)))
    (src / "c.png").write_bytes(b"no image")
    return src


def test_import_of_scans(spark, tmp_path):
    read = images.read_images(spark, str(scans(tmp_path)))
    out = str(tmp_path / "pages")
    got = {r.path.rsplit("/", 1)[-1]: r for r in importing.imported(read, out).collect()}
    assert got["c.png"].error == "cannot read image" and got["c.png"].left_path is None
    a, b = got["a.png"], got["b.png"]
    assert (a.is_single, a.method, a.spine_x, a.right_path) == (True, "single", 200, None) and a.left_path.endswith("_single.png")
    assert (b.is_single, b.method, b.image_w, b.image_h, b.error) == (False, "detected", 400, 200, None)
    spines = {r.id: (r.spine_x, r.method) for r in split.spines(split.profile_rows(importing.profiles(read), "path", "profile")).collect()}
    assert spines[b.path] == (b.spine_x, b.method)
    sizes = {r.path.rsplit("_", 1)[-1]: r.width for r in images.read_images(spark, out).collect()}
    assert sizes == {"single.png": 200, "left.png": b.spine_x, "right.png": 400 - b.spine_x}
    rows = importing.spread_rows(importing.imported(read)).orderBy("pos").collect()
    assert [(r.pos, r.original_path.rsplit("/", 1)[-1], r.split_method) for r in rows] == [(0, "a.png", "single"), (1, "b.png", "detected")] and len({r.volume_id for r in rows}) == 1
    assert importing.imported(read.limit(0)).count() == 0


def test_recogniser_gets_prepared_crops(spark, tmp_path):
    read = images.read_images(spark, str(scans(tmp_path)))
    paths = {r.path.rsplit("/", 1)[-1]: r.path for r in read.select("path").collect()}
    rows = [(paths["b.png"], "x", "body", 0.05, 0.15, 0.4, 0.2, 400, 200), (paths["b.png"], "tiny", "body", 0.0, 0.0, 0.01, 0.01, 400, 200), (paths["c.png"], "bad", "body", 0.0, 0.0, 0.5, 0.5, 400, 200)]
    found = spark.createDataFrame(rows, "path string, region_id string, rtype string, x double, y double, w double, h double, image_w int, image_h int")
    crops = {r.region_id: r for r in importing.prepared_crops(read, found.drop("image_w", "image_h")).collect()}
    assert set(crops) == {"x", "bad"} and crops["x"].crop[:4] == b"\x89PNG" and crops["x"].crop_w > 300 and crops["x"].crop_h > 90
    words = lambda asked: asked.where("crop is not null").select("region_id", F.lit(0).alias("idx"), F.lit("w").alias("word"), F.lit(90.0).alias("conf"), *(F.lit(1).alias(c) for c in ("block", "par", "line")))
    got = {r.region_id: (r.text, r.skipped) for r in detect.recognise(found, words, images=read).collect()}
    assert got == {"x": ("w", False), "tiny": ("", True), "bad": ("", False)}


def test_uploads_and_data_urls(spark, tmp_path):
    src = scans(tmp_path)
    urls = {r.path.rsplit("/", 1)[-1]: r.url for r in images.data_urls(spark, str(src)).collect()}
    assert urls["a.png"].startswith("data:image/png;base64,iVBOR") and len(urls) == 3
    query = images.landing(spark, str(src)).select("path", "length").writeStream.format("memory").queryName("uploads").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.sql("select count(*) n from uploads").collect()[0].n == 3


def test_order_after_headers_are_demoted(spark):
    # two columns; what looks like a header stands below the first body, in the right column
    px = [(1, 1, 50, 100, 400, 300, 0.5), (1, 2, 50, 430, 400, 500, 0.5), (1, 3, 550, 150, 300, 60, 0.5), (1, 4, 550, 330, 400, 600, 0.5)]
    data = spark.createDataFrame([(*p[:6], 0, 0, 1000, 1000, 1000, 1000, 100.0, p[6], 0.5) for p in px], "page_id bigint, slot bigint, bx int, by int, bw int, bh int, px int, py int, page_w int, page_h int, crop_w int, crop_h int, sharp double, td double, gutter double")
    got = [(r.slot, r.rtype, r.col_no) for r in detect.detect(data, preserve_lines=True).orderBy("ord").collect()]
    assert got == [(1, "body", 1), (2, "body", 1), (3, "body", 2), (4, "body", 2)]
    due = boxes(spark, [box(1, 0.55, 0.95, 0.4, 0.03, sure=0.8)])
    blended = detect.detect(data, due, preserve_lines=True).orderBy("ord").collect()
    assert [(r.slot, r.col_no, r.source) for r in blended][-1] == (5, 2, "template")


def test_crops_at_the_edge_and_options(spark):
    rows = [("a", "body", 0.002, 0.0, 0.012, 0.5, 1000, 1000), ("b", "pagenum", 0.99, 0.99, 0.02, 0.02, 1000, 1000), ("c", "body", 0.5, 0.5, 0.011, 0.5, 1000, 1000)]
    found = spark.createDataFrame(rows, "region_id string, rtype string, x double, y double, w double, h double, image_w int, image_h int")
    got = {r.region_id: (r.crop_x1, r.crop_x2, r.crop_y1, r.crop_y2, r.skip, r.scale) for r in text.crop_boxes(found).collect()}
    # the corner moves into the image, the size stays
    assert got == {"a": (0, 20, 0, 508, False, 1.5), "b": (982, 1000, 982, 1000, True, 3.0), "c": (496, 515, 496, 1000, True, 1.5)}
    kinds = spark.createDataFrame([("body",), ("table",), ("unknown",), ("pagenum",)], "t string")
    assert [r[0].split()[3] for r in kinds.select(text.recogniser_options(F.col("t"), F.lit("eng"))).collect()] == ["6", "3", "3", "6"]


def test_raster_kernels():
    g = np.zeros((120, 200))
    g[20:100, 30:170] = 200
    assert raster.border_box(g) == (33, 23, 134, 74)
    assert raster.border_box(np.zeros((10, 12))) == (0, 0, 12, 10)
    bound = np.full((50, 100), 200.0)
    bound[:, :6] = 20
    assert raster.binding_trim(bound)[0] == 6 and raster.binding_trim(bound)[1] == 0
    mask = np.zeros((8, 10), bool)
    mask[1:3, 1:3] = mask[3, 3] = mask[6, 7:9] = True
    assert raster.components(mask) == [(1, 1, 3, 3), (7, 6, 2, 1)]
    both = np.full((50, 100), 200.0)
    both[:, :6] = both[:, 95:] = 20
    assert raster.binding_trim(both) == (6, 5)
    ring = np.zeros((9, 12), bool)
    ring[1:8, 1:8] = True
    ring[2:7, 2:7] = False
    ring[4, 4] = ring[0, 11] = True
    assert raster.components(ring) == [(11, 0, 1, 1), (1, 1, 7, 7)]  # what lies in a hole is left out
    assert raster.components(np.ones((3, 4), bool)) == [(0, 0, 4, 3)] and raster.components(np.zeros((3, 4), bool)) == []
    rng = np.random.default_rng(1)
    noisy = np.clip(200 + rng.normal(0, 8, (40, 50)), 0, 255)
    assert raster.denoise(noisy).std() < noisy.std() / 2 and np.allclose(raster.box_mean(noisy, 7)[10, 10], noisy[7:14, 7:14].mean())
    assert raster.two_columns(np.zeros(60), np.zeros((20, 60), np.uint8)) is None
    columns = np.zeros((100, 400), np.uint8)
    columns[:, 20:180] = columns[:, 220:380] = 1
    assert 180 <= raster.two_columns(columns.sum(axis=0).astype(float), columns) < 220
    assert raster.joining_kernels(columns)[0] == 19 and raster.spine(np.full(50, 9.0)) == (25, "centre")
    assert raster.sharpness(np.full((9, 9), 7.0)) == 0
    assert raster.enlarged(np.full((4, 5), 9.0), 2.0).shape == (8, 10)
    assert set(np.unique(raster.prepared(np.full((30, 40, 3), 200, np.uint8), 1.5))) <= {0, 255}


# ------------------------------------------------------------------ templates


def test_running_statistics_like_batch_and_merge():
    rng = random.Random(3)
    values = [[rng.random() for _ in range(4)] for _ in range(40)]
    whole, a, b = template.Running(), template.Running(), template.Running()
    for i, v in enumerate(values):
        whole.add(v)
        (a if i < 13 else b).add(v)
    arr = np.array(values)
    assert np.allclose(whole.mean, arr.mean(axis=0)) and np.allclose(whole.variance(), arr.var(axis=0, ddof=1))
    both = a.merge(b)
    assert both.n == 40 and np.allclose(both.m2, whole.m2)
    again = template.Running.restored(whole.n, whole.mean, [math.sqrt(v) for v in whole.variance()])
    assert np.allclose(again.m2, whole.m2)
    assert template.Running().merge(template.Running()).n == 0


def test_slots_count_confidence_and_activity(spark):
    def pages(n):
        return [("v", p, 1, "body", 0.1, 0.2 + 0.01 * (p % 2), 0.5, 0.3) for p in range(n)] + [("v", p, 2, "unknown", 0.0, 0.0, 0.1, 0.1) for p in range(n)]

    schema = "volume_id string, page_id bigint, slot bigint, rtype string, x double, y double, w double, h double"
    for n in (1, 2, 3, 60):
        rows = spark.createDataFrame(pages(n), schema)
        found, counted = template.slots(rows), template.samples(rows).collect()[0]
        s = found.collect()
        assert len(s) == 1 and s[0].n == n and (s[0].confidence == 0) == (n < 3)
        assert counted.n_samples == min(n, 50) and counted.active == (n >= 3) and counted.needed == max(0, 3 - n)
        assert template.predicted(found, template.samples(rows)).count() == (n >= 3)


def test_templates_saved_and_read(spark, tmp_path):
    rng = random.Random(5)
    rows = [(v, 10 * n + p, 1, "body", rng.random(), rng.random(), 0.5, 0.3) for v, n in (("v", 5), ("w", 1)) for p in range(n)] + [("u", 9, 1, "unknown", 0.1, 0.1, 0.1, 0.1)]
    data = spark.createDataFrame(rows, "volume_id string, page_id bigint, slot bigint, rtype string, x double, y double, w double, h double")
    found, counted = template.slots(data), template.samples(data)
    saved = template.documents(found, counted)
    assert set(json.loads({r.volume_id: r.template for r in saved.collect()}["v"])["stats"]["body"][0]) == {"n", "mean", "std", "confidence"}
    again, counts = template.from_documents(saved.unionByName(spark.createDataFrame([("x", "{broken")], saved.schema)))
    key = lambda r: (r.volume_id, r.rtype, r.k, r.n, *(round(r[f"{m}_{c}"], 9) for m in ("mean", "var") for c in "xywh"), round(r.confidence, 9))
    assert sorted(map(key, again.collect())) == sorted(map(key, found.collect()))
    assert {(r.volume_id, r.n_samples, r.active, r.needed) for r in counts.collect()} == {("v", 5, True, 0), ("w", 1, False, 2), ("u", 1, False, 2)}
    projects.save_templates(found, str(tmp_path / "t"))
    assert projects.load_templates(spark, str(tmp_path / "t")).count() == 2 and projects.load_templates(spark, str(tmp_path / "t"), "v").count() == 1 and projects.load_templates(spark, str(tmp_path / "t"), "none").count() == 0


def test_stream_keeps_templates(spark, tmp_path):
    from vellumetry.streaming.template_state import update_templates

    schema = "volume_id string, segments array<struct<rtype:string,x:double,y:double,w:double,h:double>>"
    src = tmp_path / "in"
    pages = [("v", [("body", 0.1, 0.5, 0.3, 0.4), ("body", 0.2, 0.1, 0.3, 0.4)]), ("v", [("body", 0.4, 0.1, 0.3, 0.4), ("unknown", 0, 0, 1, 1)]), ("v", None), ("w", [("unknown", 0.0, 0.0, 1.0, 1.0)])]
    for v, segs in pages:
        spark.createDataFrame([(v, segs and [(t, *map(float, b)) for t, *b in segs])], schema).coalesce(1).write.mode("append").json(str(src))
    out = update_templates(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)))
    query = out.writeStream.outputMode("update").format("memory").queryName("templates").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = spark.sql("select volume_id, rtype, k, max_by(n, n_samples) n, max_by(mean_x, n_samples) x, max(n_samples) s from templates group by 1, 2, 3").collect()
    assert {(r.volume_id, r.rtype, r.k, r.n, r.x and round(r.x, 9), r.s) for r in rows} == {("v", "body", 0, 2, 0.3, 3), ("v", "body", 1, 1, 0.1, 3), ("w", None, None, None, None, 1)}


def test_stream_keeps_slots(spark, tmp_path):
    from vellumetry.streaming.template_state import update_slots

    schema = "volume_id string, rtype string, k bigint, x double, y double, w double, h double"
    src = tmp_path / "in"
    for n in range(2):
        spark.createDataFrame([("v", "body", 0, 0.1 * (n + 1), 0.2, 0.3, 0.4)], schema).coalesce(1).write.mode("append").json(str(src))
    out = update_slots(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)))
    query = out.writeStream.outputMode("update").format("memory").queryName("slots").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.sql("select max(n) n, max_by(mean_x, n) m from slots").collect()[0]
    assert got.n == 2 and got.m == pytest.approx(0.15)


# ------------------------------------------------------------------ text


def test_words_to_text(spark):
    rows = [("r", 0, "a ", 90.0, 1, 1, 1), ("r", 1, " ", 95.0, 1, 1, 1), ("r", 2, "b\u00a0 ", 80.9, 1, 1, 1), ("r", 3, "c", 70.0, 1, 1, 2), ("r", 4, "d", 60.0, 1, 2, 1), ("r", 5, "x", -1.0, 1, 2, 1), ("q", 0, "", -1.0, 1, 1, 1)]
    words = spark.createDataFrame(rows, "region_id string, idx int, word string, conf double, block int, par int, line int")
    flat = text.assembled(words).collect()
    assert [(r.region_id, r.text, r.confidence, r.word_count) for r in flat] == [("r", "a b\u00a0 c d", 0.75, 4)]
    late = spark.createDataFrame([("r", 0, "a", 90.0, 1, 1, 1), ("r", 1, "c", 90.0, 1, 1, 2), ("r", 2, "b\u00a0d", 90.0, 1, 1, 1)], words.schema)
    assert [(r.text, r.word_count) for r in text.assembled(late).collect()] == [("a b\u00a0d c", 4)]  # by lines, as they first appear
    assert text.assembled(words, newlines=True).collect()[0].text == "a b\u00a0\nc\n\nd"


def test_recognition_keeps_other_regions(spark):
    found = spark.createDataFrame([("a", "body", 0.1, 0.1, 0.5, 0.5, 1000, 1000), ("b", "body", 0.1, 0.1, 0.01, 0.5, 1000, 1000), ("c", "body", 0.1, 0.1, 0.5, 0.5, 1000, 1000)], "region_id string, rtype string, x double, y double, w double, h double, image_w int, image_h int")
    words = spark.createDataFrame([("a", 0, "hi", 91.0, 1, 1, 1, None), ("b", 0, "no", 91.0, 1, 1, 1, None), ("c", 0, None, None, 1, 1, 1, "stopped")], "region_id string, idx int, word string, conf double, block int, par int, line int, error string")
    got = {r.region_id: (r.text, r.skipped, r.error) for r in detect.recognise(found, lambda asked: words.join(asked.select("region_id"), "region_id", "left_semi")).collect()}
    assert got == {"a": ("hi", False, None), "b": ("", True, None), "c": ("", False, "stopped")}


def test_compiled_pages_and_volumes(spark, tmp_path):
    rows = [("p", "1", "pagenum", 0.9, "12"), ("p", "2", "header", 0.0, " T "), ("p", "3", "body", 0.5, "b"), ("p", "4", "body", None, "a"), ("p", "5", "footnote", 0.8, "f"), ("p", "6", "engraving", 0.1, "[ENGRAVING]"), ("p", "7", "body", 0.2, "  "), ("q", "8", "body", 0.1, None)]
    regs = spark.createDataFrame(rows, "page_id string, region_id string, rtype string, y double, text string")
    got = {r.page_id: r.text for r in compiling.pages(regs).collect()}
    assert got == {"p": "T\n\na\nb\n\n[ENGRAVING — illustration]\n\n\n  f\n\n" + " " * 50 + "12"}
    pages = spark.createDataFrame([("v", 0, None, "x"), ("v", 1, "", None), ("v", 2, "L", None)], "volume_id string, pos int, label string, text string")
    out = compiling.volumes(pages, F.lit("2024-05-06 07:08:00").cast("timestamp")).collect()[0]
    rule = "\n\n" + "─" * 60 + "\n"
    assert out.text == "Compiled Output\nGenerated: 2024-05-06 07:08\nPages: 3\n" + "═" * 60 + "\n\n[Page 1]\n\nx" + rule + "\n[L]\n" + rule
    assert out.n_pages == 3 and out.char_count == len(out.text)
    parts = compiling.volume_parts(pages, F.lit("2024-05-06 07:08:00").cast("timestamp"))
    assert "".join(r.part for r in parts.orderBy("pos").collect()) == out.text
    written = projects.write_parts(parts, str(tmp_path / "volumes"), "volume_id").collect()
    assert [(r.volume_id, r.char_count) for r in written] == [("v", out.char_count)]
    files = sorted((tmp_path / "volumes" / "volume_id=v").glob("*.txt"))
    assert "".join(f.read_text() for f in files) == out.text


def test_export(spark):
    rows = [("j", 0, 0, "left", "body", 0.1, "1", "b"), ("j", 0, 0, "left", "header", 0.9, "2", "h"), ("j", 0, 0, "left", "pagenum", 0.9, "3", "9"), ("j", 0, 1, "left", "footnote", 0.1, "4", " f ")]
    regs = spark.createDataFrame(rows, "project_id string, volume_pos int, spread_pos int, side string, rtype string, y double, region_id string, text string")
    names = spark.createDataFrame([("j", "My  book é!"), ("k", None)], "project_id string, name string")
    got = {r.project_id: (r.file_name, r.content, r.error) for r in compiling.TextExporter().export(regs, names).collect()}
    assert got == {"j": ("My_book_.txt", "h\n\nb\n\nf", None), "k": (".txt", None, "no text to export")}


def test_string_helpers(spark):
    row = spark.createDataFrame([("C:\\a\\b.PNG", "a<b>&", 0.625, None)], "p string, t string, v double, n string")
    got = row.select(
        strings.basename(F.col("p")), strings.media_type(F.col("p")), strings.accepted(F.col("n")), strings.escaped(F.col("t")), strings.percent(F.col("v")), strings.word_count(F.col("n")), strings.basename(F.col("n")), strings.confidence_band(F.col("v"))
    ).collect()[0]
    assert tuple(got) == ("b.PNG", "image/png", False, "a&lt;b&gt;&amp;", 63, 0, None, "mid")


# ------------------------------------------------------------------ edits


def test_edits(spark):
    segs = spark.createDataFrame([("a", "p", "body", 0.5, 0.1, 0.1, 0.2, 0.2), ("b", "p", None, 0.5, 0.1, 0.1, 0.2, 0.2)], "region_id string, page_id string, rtype string, confidence double, x double, y double, w double, h double")
    log = spark.createDataFrame([("a", 1, "header"), ("a", 2, "nonsense"), ("b", 1, "footnote")], "region_id string, at int, new_type string")
    assert {(r.region_id, r.rtype, r.confidence) for r in edits.retyped(segs, log).collect()} == {("a", "header", 1.0), ("b", "footnote", 1.0)}
    moves = spark.createDataFrame([("a", 1, 0.9, 0.9, 50.0, 50.0, 100, 100), ("a", 2, -0.5, 0.3, 1.0, 1.0, 100, 100)], "region_id string, at int, x double, y double, w_px double, h_px double, page_w int, page_h int")
    got = {r.region_id: (r.x, r.y, r.w, r.h) for r in edits.moved(segs, moves).collect()}
    assert got == {"a": (0.0, 0.3, 0.2, 0.16), "b": (0.1, 0.1, 0.2, 0.2)}
    new = spark.createDataFrame([("p", "c", "body", 0.0, 0.0, 0.1, 0.1, 9.0, 50.0), ("p", "d", "body", 0.0, 0.0, 0.1, 0.1, 10.0, 10.0)], "page_id string, region_id string, rtype string, x double, y double, w double, h double, w_px double, h_px double")
    assert {r.region_id for r in edits.drawn(segs, new).collect()} == {"a", "b", "d"}
    results = spark.createDataFrame([("a", "old", 3)], "region_id string, text string, word_count int")
    s, r = edits.deleted(segs, results, spark.createDataFrame([("a",)], "region_id string"))
    assert s.count() == 1 and r.count() == 0
    assert edits.retexted(results, spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "region_id string, at int, new_text string")).collect()[0] == Row(region_id="a", text="y", word_count=3)
    assert edits.upserted(results, spark.createDataFrame([("a", "new", 4), ("z", "n", 1)], results.schema), ["region_id"]).count() == 2
    assert edits.replaced(segs, segs.where("region_id = 'a'")).count() == 1
    assert {x.region_id for x in edits.shown_types(segs, ["body"]).collect()} == {"b"}
    assert edits.detection_flags(True) == {"merge_body": False, "preserve_paras": True, "preserve_newlines": True}


def test_reorder_and_renumber(spark):
    spreads = spark.createDataFrame([("v", c, i) for i, c in enumerate("abcde")] + [("w", "z", 0)], "volume_id string, spread_id string, pos int")
    for a, b in ((1, 3), (3, 1), (2, 2)):
        items = list("abcde")
        items.insert(b, items.pop(a))
        got = edits.reordered(spreads, spark.createDataFrame([("v", a, b)], "volume_id string, from_pos int, to_pos int")).where("volume_id = 'v'").orderBy("pos")
        assert [r.spread_id for r in got.collect()] == items
    left = edits.renumbered(spreads.where("spread_id <> 'b'")).where("volume_id = 'v'").orderBy("pos").collect()
    assert [(r.spread_id, r.pos) for r in left] == [("a", 0), ("c", 1), ("d", 2), ("e", 3)]


# ------------------------------------------------------------------ nested documents

PROJECT = {"id": "P", "volumes": [{"id": 7, "spreads": [{"id": "s", "pages": {"left": {"segments": [{"id": "a"}, None, {"id": "a"}], "ocrResults": {"a": {"text": "x"}, "gone": {"text": "y"}, "n": None}}}}]}]}


def found(spark, bodies):
    rows = spark.createDataFrame(list(enumerate(bodies)), "record_id bigint, body string")
    return {tuple(r) for r in children_with_parents(nodes(rows)).collect()}


def test_nested_forms_agree(spark):
    base = json.dumps(PROJECT)
    expected = {("7", "s", "left", "segment", "a"), ("7", "s", "left", "result", "a"), ("7", "s", "left", "result", "gone")}
    other = json.loads(base)
    page = other["volumes"][0]["spreads"][0]["pages"]["left"]
    page["ocr_results"] = [{"id": "a", "text": "x"}, None, {"id": "gone"}]
    del page["ocrResults"]
    page["segments"] = {"a": {"type": "body"}, "b": None}
    other["volumes"] = other["volumes"][0]
    other["volumes"]["spreads"][0]["pages"] = [{"side": "left", **page}]
    bodies = [base, json.dumps(base), "\ufeff" + base, json.dumps({"version": 2, "project": PROJECT}), json.dumps(other)]
    got = found(spark, bodies)
    assert got == {(i, *e) for i in range(len(bodies)) for e in expected}
    assert found(spark, [None, "", "  ", base[:-3], "[]", "3", '"x"', "{}"]) == set()
    assert found(spark, []) == set()


def test_labels_are_prefixes_and_tables_link(spark):
    listed = nodes_of(json.dumps(PROJECT))
    assert all(any(label.rsplit(".", 1)[0] == other for other, *_ in listed) for label, *_ in listed if "." in label)
    assert len({label for label, *_ in listed}) == len(listed)
    rows = spark.createDataFrame([(1, json.dumps(PROJECT), "x")], "record_id bigint, body string, label string")
    tables = flat_tables(nodes(rows))
    assert set(tables) == {"project", "volumes", "spreads", "pages", "segments", "ocrResults"}
    joined = tables["ocrResults"].alias("r").join(tables["pages"].alias("p"), F.col("r.parent") == F.col("p.label"))
    assert {(r.text, r.side) for r in joined.select("r.text", F.col("p.key").alias("side")).collect()} == {("x", "left"), ("y", "left")}


# ------------------------------------------------------------------ storage


def test_projects_round_trip(spark, tmp_path):
    doc = {"id": "P", "name": "पत्रिका x", "volumes": [{"id": "1", "name": "A", "spreads": []}, {"id": "2", "name": "B", "spreads": []}]}
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text(json.dumps(doc, ensure_ascii=False))
    read = projects.load_projects(spark, str(src))
    assert read.collect()[0].active_volume.id == "2"
    projects.save_projects(read, str(tmp_path / "out"))
    again = spark.read.schema(projects.SCHEMA).json(str(tmp_path / "out" / "project=_x"))
    assert again.collect()[0].name == doc["name"] and len(again.collect()[0].volumes) == 2
    assert [r.name for r in projects.list_projects(spark, str(src)).collect()] == ["a"]
    for n in ("eng", "osd", "ben"):
        (src / f"{n}.traineddata").write_bytes(b"x")
    assert {r.language for r in projects.list_models(spark, str(src)).collect()} == {"eng", "ben"}
    words = projects.word_table(spark.createDataFrame([("r", ["a", "b"], [90, 80], [1, 1], [1, 1], [1, 2])], "region_id string, text array<string>, conf array<int>, block_num array<int>, par_num array<int>, line_num array<int>"))
    assert [(r.word, r.line) for r in words.orderBy("idx").collect()] == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError):
        projects.save_templates(spark.createDataFrame([], "volume_id string"), str(tmp_path / "t"))
    texts = spark.createDataFrame([("v", "né\nb")], "volume_id string, text string")
    assert projects.write_texts(texts, str(tmp_path / "texts"), "volume_id").collect()[0].char_count == 4


def test_new_project_and_output(spark, tmp_path):
    some = spark.createDataFrame([("x", "A")], "id string, name string")
    got = projects.new_projects(some, "B", "2024-01-01").collect()
    assert got[1].id != projects.new_projects(some, "B", "2024-01-02").collect()[1].id
    assert [r.name for r in got] == ["A", "B"] and len(got[1].id) == 8
    assert (tmp_path / "output").exists() is False and projects.output_dir(spark, str(tmp_path)).endswith("output") and (tmp_path / "output").is_dir()


def test_grouped_merges_like_plain_python(spark):
    rng = random.Random(11)
    rows = []
    for p in range(60):
        for s in range(rng.randint(1, 6)):
            rows.append(box(s, rng.choice([0.0, 0.1, 0.5]), rng.choice([0.0, 0.1, 0.2, 0.35]), rng.choice([0.2, 0.4]), rng.choice([0.05, 0.1, 0.2]), rng.choice(["body", "header"]), rng.random(), p, rng.choice([1, 2])))
    data = boxes(spark, rows)
    names = [c.split()[0] for c in BOX.split(", ")]
    by: dict[int, list[dict]] = {}
    for r in rows:
        by.setdefault(r[0], []).append(dict(zip(names, r, strict=True)))
    key = lambda b: tuple(round(v, 9) if isinstance(v, float) else v for v in (b["page_id"], b["slot"], b["rtype"], b["x"], b["y"], b["w"], b["h"], b["confidence"]))
    got = sorted(key(r.asDict()) for r in merge.overlaps_merged(data).collect())
    assert got == sorted(key(b) for page in by.values() for b in merge.merge_overlaps(page))
    got = sorted(key(r.asDict()) for r in merge.adjacent_merged(data, "paragraphs").collect())
    split_ = lambda page, body: [b for b in page if (b["rtype"] == "body") == body]
    expected = [b for page in by.values() for b in merge.merge_adjacent(split_(page, True), 0.025) + merge.merge_adjacent(split_(page, False), 0.06)]
    assert got == sorted(map(key, expected))
