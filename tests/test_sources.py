import bz2
import gzip
import io
import json
import sqlite3
import zipfile

import numpy as np
import pytest

from siftwell.context import Options
from siftwell.plans.inspect import inspect
from siftwell.sources import readers, structure
from siftwell.sources.detect import Detection, detect, detect_column, detect_files

ROWS = [{"id": i, "name": f"n{i}", "value": i / 2, "flag": i % 2 == 0} for i in range(30)]


def csv_text(sep=","):
    return "\n".join([sep.join(ROWS[0]), *[sep.join(str(v) for v in r.values()) for r in ROWS]]) + "\n"


def xlsx_bytes():
    cells = "".join(f'<row r="{i + 1}"><c r="A{i + 1}"><v>{i}</v></c><c r="C{i + 1}" t="s"><v>0</v></c></row>' for i in range(1, 4))
    head = '<row r="1"><c r="A1" t="inlineStr"><is><t>k</t></is></c><c r="C1" t="inlineStr"><is><t>w</t></is></c></row>'
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="one" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>word</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{head}{cells}</sheetData></worksheet>")
    return out.getvalue()


def npz_bytes():
    out = io.BytesIO()
    np.savez(out, features=np.arange(40.0).reshape(20, 2), labels=np.arange(20) % 2, extra=np.zeros((2, 2, 2)))
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    p = tmp_path_factory.mktemp("files")
    (p / "a.csv").write_text(csv_text())
    (p / "b.tsv").write_text(csv_text("\t"))
    (p / "c_semicolon.csv").write_text(csv_text(";"))
    (p / "d.json").write_text(json.dumps(ROWS))
    (p / "e.jsonl").write_text("\n".join(map(json.dumps, ROWS)))
    (p / "f.yaml").write_text("app:\n  name: x\nitems:\n  - 1\n  - 2\n")
    (p / "g.xml").write_text("<r>" + "".join(f'<p id="{i}"><v>{i}</v></p>' for i in range(5)) + "</r>")
    (p / "h.ini").write_text("[a]\nk = 1\n[b]\nj = 2\n")
    (p / "i.txt").write_text("one: 1\ntwo = 2\nthree: x y\none: 9\n")
    (p / "j.html").write_text("<html><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>x</td></tr></table></html>")
    (p / "k.csv.gz").write_bytes(gzip.compress(csv_text().encode()))
    (p / "l.json.bz2").write_bytes(bz2.compress(json.dumps(ROWS).encode()))
    (p / "m.bin").write_bytes(bytes(range(256)) * 4)
    (p / "n.xlsx").write_bytes(xlsx_bytes())
    (p / "o.npz").write_bytes(npz_bytes())
    con = sqlite3.connect(p / "q.sqlite")
    con.execute('CREATE TABLE "a b" (x INTEGER PRIMARY KEY, y TEXT NOT NULL)')
    con.executemany('INSERT INTO "a b" VALUES (?, ?)', [(i, str(i)) for i in range(12)])
    con.execute('CREATE VIEW v AS SELECT x FROM "a b"')
    con.commit()
    con.close()
    with zipfile.ZipFile(p / "r.zip", "w") as z:
        z.writestr("in/a.csv", csv_text())
        z.writestr("note.txt", "plain words\nmore words\n")
    (p / "s.txt").write_text("just a line of words\nand another one\n")
    return p


WANT = {"a.csv": ("csv", 0.95), "b.tsv": ("tsv", 0.95), "c_semicolon.csv": ("csv", 0.95), "d.json": ("json", 0.95), "e.jsonl": ("jsonl", 0.95), "f.yaml": ("yaml", 0.95), "g.xml": ("xml", 0.9), "h.ini": ("ini", 0.95), "i.txt": ("text_kv", 0.65), "j.html": ("html", 0.8), "k.csv.gz": ("gzip", 0.95), "l.json.bz2": ("bzip2", 0.95), "m.bin": ("binary", 0.7), "n.xlsx": ("xlsx", 0.95), "o.npz": ("npz", 0.97), "q.sqlite": ("sqlite", 0.95), "r.zip": ("zip", 0.9), "s.txt": ("text", 0.55)}


def test_detect_files(spark, folder):
    got = {r.path.rsplit("/", 1)[-1]: (r.file_type, r.confidence) for r in detect_files(spark, str(folder)).collect()}
    assert got == WANT


@pytest.mark.parametrize(("name", "data", "kind"), [("x", b"", "text"), ("x", b"1\n2\n3\n", "jsonl"), ("x", "ü".encode() * 50, "binary"), ("x.pkl", b"\x80\x00", "pickle"), ("x", b"PAR1....", "parquet"), ("x.npz", b"PK broken", "npz"), ("x.xlsx", b"text", "xlsx"), ("x", b"---\na: 1\n", "yaml"), ("x", b"a;b\n1;2\n3;4\n", "csv"), ("x", b"a|b\n1|2\n3|4\n", "delimited")])
def test_detect_edges(name, data, kind):
    assert detect(name, data).file_type == kind


def test_pages_of_letters_beyond_ascii_are_html():
    page = "<!DOCTYPE html><html><body>" + "çéê Привет 漢字 " * 100 + "</body></html>"
    assert detect("", page.encode()).file_type == "html"
    assert detect("", page.encode()[:-40][:901], False).file_type == "html"  # cut inside of a character
    assert detect("", b"<html>" + bytes(range(128, 256)) * 4).file_type == "binary"


def test_detect_column_judges_whole_texts(spark):
    long = json.dumps({"rows": ["words of a record " * 4] * 6000})
    assert len(long) > 256 * 1024
    rows = spark.createDataFrame([(1, long), (2, long[:-1]), (3, None)], "id long, text string")
    got = {r.id: r.file_type for r in detect_column(rows, "text").collect()}
    assert got[1] == "json" and got[2] != "json" and len(got) == 3


def test_inspect_folder(spark, folder):
    reports = {r.display_name.rsplit("/", 1)[-1]: r for r in inspect(spark, str(folder), Options())}
    assert set(reports) == set(WANT)
    assert not [w for r in reports.values() for w in r.warnings if "failed" in w]
    rows = lambda n: reports[n].profile.get("rows_profiled")
    assert [rows(n) for n in ("a.csv", "b.tsv", "c_semicolon.csv", "d.json", "e.jsonl", "k.csv.gz", "l.json.bz2", "r.zip")] == [30] * 8
    assert (rows("n.xlsx"), rows("o.npz"), rows("q.sqlite"), rows("j.html"), rows("g.xml")) == (3, 20, 12, 1, 5)
    assert reports["i.txt"].summary["items"] == {"one": "1", "two": "2", "three": "x y"}
    assert reports["o.npz"].summary["tabular_preview"]["target_array"] == "labels"
    assert reports["q.sqlite"].summary["objects"][0]["row_count"] == 12 and reports["q.sqlite"].summary["objects"][1]["type"] == "view"
    assert reports["r.zip"].summary["members"][0]["file_type"] == "csv"
    assert all(len(r.findings) == 12 for r in reports.values())


def test_depth_and_record_schema():
    assert structure.depth({"a": [{"b": 1}]}, 6) == 4 and structure.depth({}, 6) == 1 and structure.depth([[[[1]]]], 2) == 2
    assert structure.record_schema([{"a": 1}, {"a": None, "b": "x"}])["schema_by_key"] == {"a": {"present_in": 2, "types": {"int": 1, "null": 1}}, "b": {"present_in": 1, "types": {"str": 1}}}


def test_mixed_json_is_no_table():
    assert list(readers.json_rows(b"[1, {}]")) == [] and list(readers.json_rows(b"{")) == [] and list(readers.json_rows(b'[{"a": 1}]')) == [{"a": 1}]


QUOTED = [(i, f'line one\nline "two" {i}', i / 2) for i in range(30)]


def quoted_csv(head="id,note,value"):
    return head + "\n" + "".join('{},"{}",{}\n'.format(i, t.replace('"', '""'), v) for i, t, v in QUOTED)


def profile_of(spark, path):
    (report,) = inspect(spark, str(path), Options())
    return report


def test_quoted_newlines_stay_in_their_record(spark, tmp_path):
    (tmp_path / "a.csv").write_text(quoted_csv())
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(quoted_csv().encode()))
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("a.csv", quoted_csv())
    for name in ("a.csv", "b.csv.gz", "c.zip"):
        assert profile_of(spark, tmp_path / name).profile["rows_profiled"] == 30, name
    got = readers.read_table(spark, str(tmp_path / "a.csv"), "csv", {"quoted": "true"}).orderBy("id").collect()
    assert [(r.id, r.note, r.value) for r in got] == QUOTED


@pytest.mark.parametrize("encoding", ["latin-1", "utf-8-sig"])
def test_encodings(spark, tmp_path, encoding):
    (tmp_path / "a.csv").write_bytes("näme,v\nMüller,1\nGroß,2\nplain,3\n".encode(encoding))
    report = profile_of(spark, tmp_path / "a.csv")
    assert report.profile["columns"] == ["näme", "v"] and report.profile["rows_profiled"] == 3


def test_large_members_and_archives_in_archives(spark, tmp_path):
    big = json.dumps([{"k": i, "text": "x" * 200} for i in range(60_000)])
    assert len(big) > 10 * 1024 * 1024
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("rows.json", big)
    (tmp_path / "big.json.gz").write_bytes(gzip.compress(big.encode()))
    with zipfile.ZipFile(tmp_path / "outer.zip", "w") as z:
        z.writestr("notes.txt", "plain words\nmore words\n")
        z.writestr("in.csv.gz", gzip.compress(csv_text().encode()))
    reports = {n: profile_of(spark, tmp_path / n) for n in ("big.zip", "big.json.gz", "outer.zip")}
    assert [reports[n].profile["rows_profiled"] for n in ("big.zip", "big.json.gz", "outer.zip")] == [60_000, 60_000, 30]
    assert any("members are summarised" in w for w in reports["big.zip"].warnings)


def test_rows_of_the_summary_stand_in_for_a_table_that_cannot_be_read(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text(csv_text())
    monkeypatch.setattr(readers, "read_table", lambda *a: 1 / 0)
    report = profile_of(spark, tmp_path / "a.csv")
    assert report.profile["rows_profiled"] == Options().preview_rows and any("rows of the summary" in w for w in report.warnings)


def test_files_of_other_formats_are_parsed_once(spark, tmp_path, monkeypatch):
    seen, make = str(tmp_path / "seen"), readers.PARSERS["yaml"]

    def counted(data):
        with open(seen, "a") as f:
            f.write("x")
        yield from make(data)

    monkeypatch.setitem(readers.PARSERS, "yaml", counted)
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.yaml").write_text(f"- a: {i}\n  b: x\n- a: {i}.5\n")
    df = readers.read_table(spark, str(tmp_path / "in"), "yaml")
    assert sorted((r.a, r.b) for r in df.collect()) == [(0.0, "x"), (0.5, None), (1.0, "x"), (1.5, None), (2.0, "x"), (2.5, None)]
    assert df.count() == 6 and df.where("a > 1").count() == 3
    assert len(open(seen).read()) == 3


def test_summary_of_json_lines_decodes_the_lines_it_shows():
    """A summary of JSON lines shows few of them, so it must not hold megabytes of lines; lines are those of splitlines, wherever pieces are cut."""
    import tracemalloc

    line = json.dumps({"k": 1, "note": "é" * 40}, ensure_ascii=False).encode() + b"\n"
    data = line * (8_000_000 // len(line))
    tracemalloc.start()
    out, _ = structure.of_jsonl(data, Detection("jsonl", 0.95, "", {}), Options())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out["lines_sampled"] == out["parsed"] == 5 * Options().preview_rows and peak < 2_000_000
    for odd in (b"", b"\n", b" \r\n\r\na\r\n\n b\rc\x0bd\xe2\x80\xa8e\xc3\xa9\xff\xc3", b"one", b"a\r", b"\xe2\x80\xa8" * 5 + b"x\r\n"):
        for piece in (1, 2, 3, 7, 100):
            assert list(structure.solid_lines(odd, piece)) == [x for x in odd.decode("utf-8", "replace").splitlines() if x.strip()]
