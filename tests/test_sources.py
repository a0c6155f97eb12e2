import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
from pyspark.sql import functions as F

from platewright.sources import backends, files, sinks, tei
from platewright.streaming.jobs import job_states
from platewright.vision import images, pixels


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"', [1, 2]), (2, None, None)], "b int, a string, c array<int>")
    sinks.write_jsonl(df, f"{tmp_path}/l")
    assert files.read_jsonl(spark, f"{tmp_path}/l", df.schema).exceptAll(df).count() == 0
    sinks.write_csv(df, f"{tmp_path}/c", quote_all=True)
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/c")
    assert back.columns == ["a", "b", "c"] and back.where("b = 1").first().a == 'a "b"'
    sinks.write_json(df, f"{tmp_path}/j.json")
    assert json.load(open(f"{tmp_path}/j.json"))[1] == {"b": 2, "a": None, "c": None}
    sinks.append_log(df, f"{tmp_path}/log")
    sinks.append_log(df, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 4
    sinks.write_manifests(df.withColumn("paper_id", F.lit("p")), f"{tmp_path}/m")
    assert os.path.isdir(f"{tmp_path}/m/paper_id=p")


def test_assets_are_copied_and_missing_ones_kept(spark, tmp_path):
    source = tmp_path / "x.png"
    source.write_bytes(b"1")
    df = spark.createDataFrame([(str(source),), ("gone.png",), (None,)], "panel_path string")
    got = [r[0] for r in sinks.copy_assets(df, f"{tmp_path}/out").collect()]
    assert got == [f"{tmp_path}/out/x.png", "gone.png", None]


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "b.txt").write_text("x\n\n x \ny\n")
    assert files.scan_pdfs(spark, str(tmp_path)).count() == 1
    assert sorted(r.name for r in files.read_lexicon(spark, f"{tmp_path}/b.txt").collect()) == ["x", "y"]
    config = files.PipelineConfig(dpi=300, extra={"k": 1})
    files.save_config(config, f"{tmp_path}/c.json")
    assert files.load_config(f"{tmp_path}/c.json") == config and files.load_config(f"{tmp_path}/none.json") == files.PipelineConfig()
    assert files.read_jsonl(spark, f"{tmp_path}/none.jsonl", "a int", missing_ok=True).count() == 0


def test_tei(spark):
    text = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div><head>Methods</head><p>a <ref>b</ref></p></div><div/><figure xml:id="fig_0"><head>Fig. 1</head><figDesc>(A) Aaa bbb</figDesc></figure></body></text></TEI>'
    docs = spark.createDataFrame([(1, text), (2, "<broken"), (3, None), (4, " ")], "id int, xml string")
    got = tei.captions_of(docs, "id", "xml").collect()
    assert [(r.figure_id, r.caption, r.figure_number, r.taxa) for r in got] == [("fig1", "Fig. 1 (A) Aaa bbb", "1", ["Aaa bbb"])]
    assert tei.captions_of(docs, "id", "xml", use_xml_id=True).first().figure_id == "fig_0"
    assert [(r.section_id, r.title, r.section_type, r.text) for r in tei.sections_of(docs, "id", "xml").collect()] == [("sec_1", "Methods", "materials_methods", "a b")]


class _Reply(BaseHTTPRequestHandler):
    def do_POST(self):
        self.rfile.read(int(self.headers["Content-Length"]))
        known = {"/api/generate": {"response": "{}"}, "/completion": {"content": "plain"}}
        body = json.dumps(known[self.path]).encode() if self.path in known else b""
        self.send_response(200 if self.path in known else 404)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_backends_turn_failures_into_rows(spark):
    server = HTTPServer(("127.0.0.1", 0), _Reply)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    rows = spark.createDataFrame([(1, "q"), (2, None)], "id int, p string")
    assert backends.ask(rows, "id", "p", lambda: backends.GenerateEndpoint(url, "m")).first().answer == "{}"
    assert backends.ask(rows, "id", "p", lambda: backends.ChatEndpoint(url)).first().answer == "plain"
    pdfs = spark.createDataFrame([("p", "a.pdf", bytearray(b"x"))], "paper_id string, path string, content binary")
    bad = backends.parse_papers(pdfs, lambda: backends.FulltextService(url)).first()
    assert not bad.success and "404" in bad.error
    server.shutdown()
    assert backends.render_pages(pdfs).first().error


def _page():
    image = np.full((400, 600), 255, dtype=np.uint8)
    image[40:180, 50:250] = 30
    image[220:380, 300:560] = 60
    return image


def test_regions_and_panels_of_drawn_pages(spark, tmp_path):
    (tmp_path / "p.png").write_bytes(images.png(_page()))
    (tmp_path / "broken.png").write_bytes(b"no image")
    table = images.read_images(spark, str(tmp_path))
    assert table.count() == 1
    got = images.find_panels(table).orderBy("panel_index").collect()
    assert len(got) == 2 and all(abs(a - b) <= 2 for r, want in zip(got, ((50, 40, 200, 140), (300, 220, 260, 160))) for a, b in zip((r.x, r.y, r.w, r.h), want))
    assert images.find_regions(table).count() == 2
    assert images.crops(table, images.find_panels(table)).count() == 2
    assert pixels.figure_regions(np.full((50, 50), 255, dtype=np.uint8)) == [((0, 0, 50, 50), 0.5, "page")]


def test_pixels():
    line = np.full((60, 200), 255, dtype=np.uint8)
    line[40:44, 20:152] = 0
    assert abs(pixels.scale_bar_length(line) - 131) <= 2 and pixels.scale_bar_length(np.zeros((20, 20), np.uint8)) is None
    assert [c[:4] for c in pixels.components(np.eye(3, dtype=np.uint8))] == [(0, 0, 3, 3)]
    assert pixels.resized(400, 100, 200) == (200, 50)
    noisy = np.clip(_page()[:60, :60].astype(int) + np.random.default_rng(0).integers(-9, 9, (60, 60)), 0, 255).astype(np.uint8)
    assert pixels.for_recognition(noisy).shape == (60, 60)


def test_job_stream(spark, tmp_path):
    rows = spark.createDataFrame([("j", "queued", "2024-01-01 00:00:00"), ("j", "done", "2024-01-01 00:05:00")], "job_id string, status string, t string").select("job_id", "status", F.to_timestamp("t").alias("ts"))
    rows.write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("job_id string, status string, ts timestamp").json(f"{tmp_path}/in")
    query = job_states(stream).writeStream.outputMode("update").format("memory").queryName("job_states").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r.status for r in spark.table("job_states").collect()][-1] == "done"


def test_description_first(spark):
    from platewright.sources.tei import captions_of

    xml = "<TEI><text><body><figure><label>9</label><head>Fig. 1</head><figDesc>(A) Foo barum</figDesc><note>n</note></figure></body></text></TEI>"
    df = spark.createDataFrame([(1, xml)], "i long, x string")
    assert captions_of(df, "i", "x").first().caption == "Fig. 1 (A) Foo barum n 9"
    assert captions_of(df, "i", "x", description_first=True).first().caption == "(A) Foo barum Fig. 1 n"


def test_small_csv_training_set_and_pictures(spark, tmp_path):
    import pytest

    from platewright.sources.files import read_matcher_training, with_job_ids
    from platewright.sources.sinks import browser_columns, panels_of_figures, write_csv_rows, write_pictures

    write_csv_rows([{"b": 1, "a": "x,y"}, {"b": 2}], f"{tmp_path}/s/r.csv")
    assert open(f"{tmp_path}/s/r.csv", newline="").read() == 'b,a\r\n1,"x,y"\r\n2,\r\n'
    write_csv_rows([], f"{tmp_path}/e.csv")
    assert open(f"{tmp_path}/e.csv").read() == ""
    with pytest.raises(ValueError):
        write_csv_rows([{"a": 1}, {"b": 2}], f"{tmp_path}/x.csv")
    with open(f"{tmp_path}/t.jsonl", "w") as f:
        f.write('{"panel_features": [[1, 2]], "target_panel_label": [0], "more": 1}\n\n')
    row = read_matcher_training(spark, f"{tmp_path}/t.jsonl").first()
    assert row.panel_features == [[1.0, 2.0]] and row.target_panel_label == [0] and row.species_features is None
    assert len({r.job_id for r in with_job_ids(spark.range(3)).collect()}) == 3
    pictures = spark.createDataFrame([("p/f/panel_01.png", b"abc"), ("p/f/panel_02.png", None), (None, b"x")], "panel_file string, png binary")
    assert [tuple(r) for r in write_pictures(pictures, f"{tmp_path}/panels").collect()] == [("p/f/panel_01.png", 3)]
    assert open(f"{tmp_path}/panels/p/f/panel_01.png", "rb").read() == b"abc"
    boxes = spark.createDataFrame([("f", 1, 5, 6, 7, 8, 0.5), ("f", 0, 1, 2, 3, 4, 0.9)], "path string, panel_index int, x int, y int, w int, h int, score double")
    assert [p.bbox for p in panels_of_figures(boxes).first().panels] == [[1, 2, 3, 4], [5, 6, 7, 8]]
    rows = spark.createDataFrame([("p", "f", None, None, 0.5, "extra")], "paper_id string, figure_id string, panel_id string, species string, confidence double, more string")
    assert browser_columns(rows).columns[0] == "论文ID" and tuple(browser_columns(rows).first()) == ("p", "f", "", "", 0.5)
