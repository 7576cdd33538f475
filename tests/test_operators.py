"""Operators on tables: every catalog query with SQL against DuckDB, and both ways of operators that have two."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import catalog

SF = "/root/testdata/sf0.001"
catalog.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries whose SQL takes long; the driver runs them all.
SLOW = {"dot_rows"}


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _text(v):
    if v is None:
        return ""
    if isinstance(v, (float, np.floating)) and float(v).is_integer():
        return str(int(v))
    return str(v)


@pytest.mark.parametrize("name", sorted(set(catalog.SQL) - SLOW))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(map(_text, r)) for r in df.select(*names).collect())
    cursor = duck.execute(catalog.SQL[name])
    at = [[d[0] for d in cursor.description].index(n) for n in names]
    assert sorted(d[0] for d in cursor.description) == names
    want = sorted(tuple(_text(r[i]) for i in at) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_other_queries_run(spark, duck, name):
    assert catalog.QUERIES[name](spark, SF).limit(5).count() > 0


def test_dbscan_ways_agree(spark):
    from quern.operators.cluster import Dbscan, radius_neighbors

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.3, (40, 3)) for c in range(4)] + [rng.uniform(-3, 6, (30, 3))])
    df = spark.createDataFrame([(i * 3 + 1, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(5)
    near = sorted(map(tuple, Dbscan(0.4, 5).fit(df).collect()))
    far = sorted(map(tuple, Dbscan(0.4, 5).fit(df, local_rows=0).collect()))
    assert near == far
    a = sorted(map(tuple, radius_neighbors(df, 0.4, block_rows=30).collect()))
    b = sorted(map(tuple, radius_neighbors(df, 0.4).collect()))
    assert a == b and len(set(a)) == len(a)


def test_nms_survivors_do_not_overlap(spark):
    from quern.operators.detect import nms, pairwise_iou
    from quern.catalog.boxes import lineitem_boxes

    if not os.path.isdir(SF):
        pytest.skip("no test data")
    kept = nms(lineitem_boxes(spark, SF).filter("img_id = 1"), 0.45, ["img_id"])
    pairs = pairwise_iou(kept.drop("rank"), kept.drop("rank"), ["img_id"]).filter("a_idx < b_idx")
    assert pairs.filter(F.col("iou") > F.lit(0.45).cast("float")).count() == 0


def test_detector_values(spark):
    from quern.operators.detect import Detector

    rows = [(1, 0, 10.0, 10.0, 10.0, 10.0, [0.1, 0.9]), (1, 1, 10.5, 10.0, 10.0, 10.0, [0.8, 0.7]), (1, 2, 50.0, 50.0, 5.0, 5.0, [0.1, 0.2])]
    df = spark.createDataFrame(rows, "img_id long, row long, b0 float, b1 float, b2 float, b3 float, class_scores array<float>")
    pick = lambda d: [(r["index"], r["class"]) for r in d.detect(df, ["img_id"]).orderBy("rank").collect()]
    assert pick(Detector()) == [(0, 1), (1, 0)]
    assert pick(Detector(class_agnostic=True)) == [(0, 1)]
    assert [c for _, c in pick(Detector(multi_label=True, iou_threshold=0.99))] == [1, 0, 1]


def test_unletterbox_value(spark):
    from quern.functions.boxes import unletterbox

    df = spark.createDataFrame([(0.0, 16.0, 64.0, 48.0)], "x1 float, y1 float, x2 float, y2 float")
    out = df.select(*unletterbox(("x1", "y1", "x2", "y2"), (F.lit(64), F.lit(64)), (F.lit(200), F.lit(100)))).first()
    assert list(out) == [0, 0, 200, 100]


def test_media_sources(spark, tmp_path):
    from quern.sources import media

    x = np.random.default_rng(7).integers(0, 256, (4, 6, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(media.encode_png(x))
    (tmp_path / "b.png").write_bytes(b"broken")
    rows = {r.path[-5:]: r for r in media.read_images(spark, str(tmp_path / "*.png"), tolerant=True).collect()}
    assert bytes(rows["a.png"].image.data) == x.tobytes() and rows["b.png"].image is None and rows["b.png"].error
    (tmp_path / "c.wav").write_bytes(media.encode_wav(np.array([0.5, -0.5]), 8000))
    r = media.read_wav(spark, str(tmp_path / "*.wav")).first()
    assert (r.sample_rate, r.samples) == (8000, [0.5, -0.5])


def test_waveform_rejects_other_rates(spark):
    from quern.operators.audio import waveforms
    from quern.plans.audio import WaveformProcessor

    df = spark.createDataFrame([(8000, [1.0, 2.0])], "sample_rate int, samples array<float>")
    with pytest.raises(Exception, match="expected 16000"):
        waveforms(df, WaveformProcessor()).collect()


def test_streams(spark, tmp_path):
    from quern.functions.boxes import area
    from quern.operators.detect import nms
    from quern.streaming.rows import per_batch

    df = spark.createDataFrame([(1, i, float(i), 0.0, float(i) + 10, 10.0, 1.0 - i / 10) for i in range(4)], "img_id long, idx long, x1 float, y1 float, x2 float, y2 float, score float")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert stream.select(area(("x1", "y1", "x2", "y2"))).isStreaming
    out = str(tmp_path / "out")
    per_batch(stream, lambda b: nms(b, 0.5, ["img_id"]), lambda b, n: b.write.mode("overwrite").parquet(f"{out}/{n}"), str(tmp_path / "cp")).awaitTermination(120)
    got = sorted(r.idx for r in spark.read.parquet(f"{out}/0").collect())
    assert got == sorted(r.idx for r in nms(df, 0.5, ["img_id"]).collect())


def test_box_iou_all_gives_every_pair_of_an_image(spark, duck):
    from quern.catalog.boxes import lineitem_boxes

    boxes = lineitem_boxes(spark, SF)
    image = boxes.agg(F.min("img_id")).first()[0]
    rows = boxes.filter(F.col("img_id") == image).orderBy("idx").collect()
    x = np.array([[r.x1, r.y1, r.x2, r.y2] for r in rows], np.float32)
    size = (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    side = lambda k: np.maximum(np.minimum(x[:, None, k + 2], x[None, :, k + 2]) - np.maximum(x[:, None, k], x[None, :, k]), np.float32(0))
    common = side(0) * side(1)
    want = common / (size[:, None] + size[None] - common)
    got = catalog.QUERIES["box_iou_all"](spark, SF).filter(F.col("img_id") == image).orderBy("a_idx", "b_idx").toArrow()
    assert got.num_rows == len(rows) ** 2 and (want == 0).any()
    assert np.array_equal(got["iou"].to_numpy().reshape(want.shape), want)
    assert got["a_idx"].to_pylist()[:: len(rows)] == [r.idx for r in rows]


def test_encode_padded_longest_whole_cuts_nothing(spark, duck):
    ids = {r.doc_id: r.ids.split() for r in catalog.QUERIES["wordlevel_encode"](spark, SF).collect()}
    longest = {}
    for i, v in ids.items():
        longest[i % 10] = max(longest.get(i % 10, 0), len(v) + 2)
    assert max(longest.values()) > 1000
    got = {r.doc_id: (r.ids.split(), r.ones) for r in catalog.QUERIES["encode_padded_longest_whole"](spark, SF).collect()}
    assert got == {i: (["1", *v, "2"] + ["0"] * (longest[i % 10] - len(v) - 2), len(v) + 2) for i, v in ids.items()}


def test_blocks_are_written_to_the_shuffle_once(spark):
    """A row was sent once for every block of the other table."""
    from quern.operators.cluster import dot_rows, radius_neighbors

    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(90)], "vec_id long, embedding array<float>")
    for df in (dot_rows(rows, rows, block_rows=10), radius_neighbors(rows, 0.5, block_rows=10)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Generate" not in plan and "FlatMapCoGroups" not in plan
    got = {(r.a_id, r.b_id): r.dot for r in dot_rows(rows, rows, block_rows=10).collect()}
    assert got == {(i, j): float((i % 7) * (j % 7) + (i % 5) * (j % 5)) for i in range(90) for j in range(90)}


def test_pairs_of_small_tables_are_dealt_out(spark):
    """A table small enough to be broadcast left all pairs to the tasks that read the file: one."""
    from quern.operators.detect import pairwise_iou

    boxes = spark.range(4000).selectExpr("id % 40 AS img_id", "id AS idx", "CAST(id % 9 AS FLOAT) AS x1", "CAST(id % 7 AS FLOAT) AS y1", "CAST(10 AS FLOAT) AS x2", "CAST(10 AS FLOAT) AS y2").coalesce(1)
    done = pairwise_iou(boxes, boxes, ["img_id"])
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert done.count() == 40 * 100 * 100


def test_pixels_of_a_large_image_are_read_once(spark):
    """Each pixel once had the whole image turned into hexadecimal digits again: this one would not end."""
    from quern.operators import image as op

    x = np.random.default_rng(0).integers(0, 256, (310, 290, 3)).astype(np.uint8)
    assert x.size > 4 * op.PART
    df = spark.createDataFrame([(7, (290, 310, bytearray(x.tobytes()))), (8, (0, 0, bytearray())), (9, None), (10, (1, 2, bytearray(b"ab")))], f"img_id long, image {op.IMAGE_DDL}")
    done = op.explode_pixels(df, ["img_id"])
    assert "hex(" not in done._jdf.queryExecution().optimizedPlan().toString()
    assert {f.name: f.dataType.simpleString() for f in done.schema} == {"img_id": "bigint", "y": "int", "x": "int", "c": "int", "v": "int"}
    t = done.orderBy("img_id", "y", "x", "c").toArrow()
    assert t["img_id"].to_pylist() == [7] * x.size + [10, 10] and t["v"].to_pylist()[-2:] == [97, 98] and t["y"].to_pylist()[-2:] == [0, 1]
    y, at, c = (t[k].to_numpy()[:-2] for k in "yxc")
    assert np.array_equal(t["v"].to_numpy()[:-2], x[y, at, c]) and np.array_equal((y * 290 + at) * 3 + c, np.arange(x.size))


@pytest.mark.parametrize("name", ["letterbox_pixels", "resize_pixels", "tile_pixels", "resize_nearest", "resize_no_antialias", "resize_kernel_hamming", "resize_kernel_box"])
def test_images_of_a_small_file_are_dealt_out(spark, tmp_path, name):
    """All images were made in the one task that reads the file; sums over pixels were shuffled pixel by pixel."""
    spark.range(200).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    done = catalog.QUERIES[name](spark, str(tmp_path))
    assert done.select("img_id", F.spark_partition_id().alias("p")).distinct().groupBy("img_id").count().agg(F.max("count")).first()[0] == 1
    assert done.select(F.spark_partition_id()).distinct().count() >= 8


@pytest.fixture(scope="module")
def odd_documents(tmp_path_factory):
    """Texts that are null, empty or of spaces, and texts that hold the names of special tokens, some of them among the vocabulary."""
    d = str(tmp_path_factory.mktemp("odd"))
    texts = [None, "", "   ", " a  b ", "<pad> a <end> b", "<other> <other> c", "<begin>", "a\tb   é", "b <other>", "x" * 3 + " " + "a " * 90]
    rare = " ".join(f"w{i}" for i in range(2500))
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", list(enumerate([*texts, rare, rare + " <pad> <end>"])))
    c.execute(f"copy documents to '{d}/documents.parquet' (format parquet)")
    return d, c


@pytest.mark.parametrize("name", ["processor_encode", "processor_truncate", "processor_batch", "processor_decode"])
def test_processors_equal_sql_on_odd_texts(spark, odd_documents, name):
    d, c = odd_documents
    df = catalog.QUERIES[name](spark, d)
    want = sorted(c.execute(f"select {', '.join(df.columns)} from ({catalog.SQL[name]})").fetchall())
    assert sorted(map(tuple, df.collect())) == want


@pytest.mark.parametrize("name", ["fill_poly", "fill_poly_quads", "min_area_rect"])
def test_quads_of_a_small_file_are_dealt_out(spark, tmp_path, name):
    """All of them were made in the one task that reads the file, pixels as Python tuples."""
    spark.range(400).selectExpr("id AS p_partkey", "int(id % 50 + 1) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert catalog.QUERIES[name](spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() >= 8


def test_rows_are_turned_into_objects_a_few_at_a_time(spark, monkeypatch):
    """A whole Arrow batch of maps was turned into Python numbers at once: the time between its rows says nothing, their number does."""
    import pyarrow as pa

    from quern.operators import ocr as op

    sizes = []

    class Batches:
        sparkSession = spark

        class schema(list):
            pass

    def run(f, ddl):
        rows = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([{"h": 2, "w": 2, "data": [0.0, 1.0, 1.0, 1.0]}] * 1000)], ["vec_id", "mask"])
        sizes.extend(b.num_rows for b in f([rows]))
        return sizes

    df = Batches()
    df.schema = spark.createDataFrame([], "vec_id long, mask struct<h:int,w:int,data:array<float>>").schema
    df.mapInArrow = run
    op.find_contours(df)
    assert sum(sizes) == 1000 and max(sizes) <= 64


def test_padding_of_texts_is_one_repeated_text(spark, duck):
    """Padding was an array of ids and one of the mask for each row, of the longest row's length, turned into text id by id."""
    from quern.operators.text import pad_texts

    df = spark.createDataFrame([(1, "1 7 2", 3, 0), (2, "1 2", 2, 0), (3, "1 5 6 2", 4, 1)], "doc_id long, ids string, ones int, batch int")
    assert sorted((r.doc_id, r.ids, r.ones) for r in pad_texts(df, 0, ["batch"]).collect()) == [(1, "1 7 2", 3), (2, "1 2 0", 2), (3, "1 5 6 2", 4)]
    plan = catalog.QUERIES["encode_padded_longest_whole"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_repeat" not in plan and "attention_mask" not in plan


def test_sentencepiece_takes_a_few_texts_at_a_time(spark, monkeypatch):
    """All texts of an Arrow batch, 10,000 of them, were ids in Python lists at once."""
    import pyarrow as pa

    from quern.catalog import text

    class Table:
        def select(self, *_):
            return self

        def mapInArrow(self, f, ddl):
            t = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([0] * 300), pa.array(["the tea"] * 300)], ["conv_id", "turn", "text"])
            return [b.num_rows for b in f([t])]

    monkeypatch.setattr(text, "table", lambda *_: Table())
    sizes = catalog.QUERIES["sp_unigram_encode"](spark, SF)
    assert sum(sizes) == 300 and max(sizes) <= 64
