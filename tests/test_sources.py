"""Sources and sinks: category config, harvest files, broker option maps,
Avro gate, schema (S1, S3, S5, S7, S10, S11, S12, C6)."""

import json

from pyspark.sql import functions as F

from shoplytics.sources import harvest as hv
from shoplytics.sources import kafka
from shoplytics.sources.schemas import SHOP_EVENT, ddl

CONFIG = """
categories:
  - bridges:
      keywords:
        - viaduct
        - arch
  - teapots:
      keywords:
        - porcelain
"""


def test_category_config(spark):
    rows = hv.category_config(spark, CONFIG).orderBy("category_pos", "keyword_pos").collect()
    assert [(r["category"], r["keyword"]) for r in rows] == \
        [("bridges", "viaduct"), ("bridges", "arch"), ("teapots", "porcelain")]


def test_harvest_files_category_and_order(spark, tmp_path):
    a, b = tmp_path / "cars.json", tmp_path / "boats.v1.json"
    a.write_text(json.dumps({"id": "1", "title": "x", "favs": 40,
                             "info": {"tags": ["t"]}, "sizes": {}}) + "\n")
    b.write_text(json.dumps({"id": "1", "title": "y", "favs": 31}) + "\n")
    df = hv.read_harvest(spark, [str(a), str(b)])
    got = sorted((r["category"], r["file_pos"], r["title"]) for r in df.collect())
    assert got == [("boats.v1", 1, "y"), ("cars", 0, "x")]


def test_harvest_partitioned_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("1", "x", 40, "cars"), ("2", "y", 50, "boats")],
                               "id string, title string, favs int, category string")
    hv.write_harvest(df, str(tmp_path / "out"))
    back = hv.read_harvest(spark, str(tmp_path / "out"))
    assert sorted((r["id"], r["category"]) for r in back.collect()) == [("1", "cars"), ("2", "boats")]


def test_broker_options():
    src = kafka.source_options(["b1:9092", "b2:9092"], group="g")
    assert src["kafka.bootstrap.servers"] == "b1:9092,b2:9092"
    assert src["kafka.group.id"] == "g" and src["startingOffsets"] == "latest"
    sink = kafka.sink_options("b:9092")
    assert sink["kafka.compression.type"] == "lz4" and sink["kafka.acks"] == "1"


def test_avro_decoder_is_gated(spark):
    df = spark.createDataFrame([(bytearray(b"\x00"),)], "value binary")
    schema = json.dumps({"type": "record", "name": "E",
                         "fields": [{"name": "eventType", "type": "string"}]})
    try:
        col = kafka.decode_avro(F.col("value"), schema)
        df.select(col).collect()
    except Exception as ex:  # no spark-avro package here
        assert "AVRO" in str(ex).upper()


def test_event_schema_has_33_fields():
    assert len(SHOP_EVENT.fields) == 33
    assert ddl(SHOP_EVENT).startswith("detectedDuplicate:boolean")


def test_kafka_reader_gate_and_views(spark):
    try:
        kafka.read_stream(spark, "localhost:1")
    except RuntimeError as ex:                 # no connector jar: a clear message
        assert "archive" in str(ex)
    from shoplytics.sources.tables import register_views
    from tests.conftest import SF001
    register_views(spark, SF001, ("events", "part"))
    assert spark.sql("SELECT count(*) FROM events").first()[0] > 0


def test_page_number_shape(spark):
    from shoplytics.functions import ids
    df = spark.createDataFrame([("0",), ("999",), ("1000",), ("x",)], "p string")
    assert [r[0] for r in df.select(ids.is_page_number("p")).collect()] == [True, True, False, False]


def test_kafka_writer_builds_without_starting(spark, tmp_path):
    from pyspark.sql.streaming import DataStreamWriter
    src = spark.readStream.schema("eventId string, eventType string").json(str(tmp_path))
    w = kafka.write_stream(src, "localhost:1", str(tmp_path / "ckpt"))
    assert isinstance(w, DataStreamWriter)          # started only where a broker exists


def test_harvest_file_positions_follow_the_given_paths(spark, tmp_path):
    """Files of one base name, or of overlapping names, keep their own positions."""
    from shoplytics.sources import harvest as hv
    paths = [tmp_path / "a" / "boats.json", tmp_path / "b" / "boats.json", tmp_path / "a" / "oldboats.json"]
    for i, p in enumerate(paths):
        p.parent.mkdir(exist_ok=True)
        p.write_text('{"id": "%d", "title": "t%d"}\n' % (i, i))
    got = hv.read_harvest(spark, [str(p) for p in paths]).select("id", "category", "file_pos").collect()
    assert sorted((r.id, r.category, r.file_pos) for r in got) == [("0", "boats", 0), ("1", "boats", 1), ("2", "oldboats", 2)]
