import zipfile

from actloom.sources import files
from actloom.streaming import versions


def test_files_in_all_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("строка\r\nдва".encode("cp1251"))
    (tmp_path / "b.txt").write_bytes("﻿строка".encode("utf-8"))
    (tmp_path / "c.xml").write_text("<r><a>один</a> <b>два</b></r>")
    (tmp_path / "d.bin").write_bytes(b"x")
    (tmp_path / "g.xml").write_text("<r><a>")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "f.docx", "w") as z:
        cell = "<w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Абзац</w:t></w:r></w:p><w:tbl><w:tr>{cell.format("1")}{cell.format("2")}</w:tr></w:tbl></w:body></w:document>')
    got = {r.filename: (r.extracted_text, r.error) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("строка\nдва", None) and got["b.txt"] == ("строка", None)
    assert got["c.xml"] == ("один\nдва", None) and got["f.docx"] == ("Абзац\n1 | 2", None)
    assert got["d.bin"] == (None, "unsupported format") and got["g.xml"] == (None, "unreadable: ParseError")


def test_empty_content_is_an_error_row(spark):
    df = spark.createDataFrame([("x/e.txt", 0, bytearray()), ("x/n.txt", 0, None)], "path string, length bigint, content binary")
    assert {r.error for r in files.extract(df).collect()} == {"empty file"}


def test_acts_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a1", 'О "чём" & как', "2020-01-02", "текст  <b>\nакта")], "id string, heading string, date string, body string")
    xml = files.act_xml(df, ["id", "heading", "date"], "body").first().xml
    (tmp_path / "x.xml").write_text(xml)
    r = files.read_acts(spark, str(tmp_path)).first()
    assert (r.act_id, r.heading, str(r.document_date), r.cleaned_text) == ("a1", 'О "чём" & как', "2020-01-02", "текст <b> акта")


def test_csv_and_json(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"\nb'), (2, None)], "id int, t string")
    files.write_csv(df, str(tmp_path / "c"), ["id", "t"])
    assert sorted((r.id, r.t or "") for r in files.read_csv(spark, str(tmp_path / "c"), "id int, t string").collect()) == [(1, 'a "q"\nb'), (2, "")]
    (tmp_path / "j.json").write_text('[{"id": 1}, {"id": 2}]')
    assert files.read_json(spark, str(tmp_path / "j.json"), "id int").count() == 2


def test_upsert(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(2, "c"), (3, None)], "k int, v string")
    assert sorted((r.k, r.v or "", r.change) for r in files.upsert(t, s, "k").collect()) == [(1, "a", "kept"), (2, "c", "updated"), (3, "", "created")]


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("раз")
    q = files.stream_documents(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("streamed").start()
    q.processAllAvailable()
    (tmp_path / "in" / "b.txt").write_text("два")
    q.processAllAvailable()
    q.stop()
    assert sorted(r.extracted_text for r in spark.sql("select * from streamed").collect()) == ["два", "раз"]


def test_streamed_versions_once(spark, tmp_path):
    kind = "id int, at timestamp"
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-02 00:00:00"), (2, "2024-01-01 00:30:00")], "id int, s string").selectExpr("id", "timestamp(s) at").write.parquet(str(tmp_path / "p"))
    q = versions.first_deliveries(spark.readStream.schema(kind).parquet(str(tmp_path / "p")), "id", "at").writeStream.format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select id from once").count() == 2


def test_docx_cells_and_nested_tables():
    import io
    import zipfile

    from actloom.sources.files import docx_text

    par = lambda *ts: "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in ts)
    table = lambda *cells: f"<w:tbl><w:tr>{''.join(f'<w:tc>{c}</w:tc>' for c in cells)}</w:tr></w:tbl>"
    body = par("start") + table(par("first", "second"), par("outer") + table(par("inner")))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    assert docx_text(data.getvalue()) == "start\nfirst\nsecond | outer\ninner"
