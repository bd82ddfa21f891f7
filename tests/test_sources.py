"""Readers against small files made here."""

from __future__ import annotations

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from prospark.sources import files
from prospark.sources.paged import PagedSource


def test_separator():
    assert files.separator('a;b,c;"x,y,z"') == ";"
    assert files.separator("a\tb\tc,d") == "\t"
    assert files.separator("a,b") == ","
    assert files.separator("a") == ";"


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('Numéro;Raison Sociale\n1;"Dupont ""et"" fils;\nsuite"\n\n2;-\n', encoding="utf-8")
    df = files.read_csv(spark, str(p), required=["numero"])
    rows = {r.numero: r.raison_sociale for r in df.collect()}
    assert rows == {"1": 'Dupont "et" fils;\nsuite', "2": None}
    with pytest.raises(ValueError):
        files.read_csv(spark, str(p), required=["siret"])


def test_csv_text():
    assert files.parse_csv_text("a,b\n1,\"x\ny\"\n , \n") == [["a", "b"], ["1", "x\ny"]]


def test_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    p = tmp_path / "b.xlsx"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>nom</t></si><si><r><t>a</t></r><r><t>&amp;b</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>ville</t></is></c></row><row r="2"/><row r="3"><c r="B3"><v>7</v></c><c r="C3" t="s"><v>1</v></c></row></sheetData></worksheet>')
    rows = [(r.row, r.cells) for r in files.read_xlsx(spark, str(p)).orderBy("row").collect()]
    assert rows == [(0, ["nom", "", "ville"]), (2, ["", "7", "a&b"])]


def test_vcard(spark, tmp_path):
    p = tmp_path / "c.vcf"
    p.write_text("BEGIN:VCARD\r\nN:Doe;Jane;;;\r\nORG:Acme\\, Inc;Sales\r\nEMAIL;TYPE=work:Jane@X.fr\r\nEMAIL:b@x.fr\r\nTEL:+33 6\r\n  12\r\nURL:https://linkedin.com/in/jane\r\nitem1.URL:https://x.fr\r\nEND:VCARD\r\nBEGIN:VCARD\nFN:Prince\nEND:VCARD\n")
    a, b = sorted(files.read_vcard(spark, str(p)).collect(), key=lambda r: r.nom)
    assert (a.prenom, a.nom, a.societe, a.email, a.tel, a.linkedin, a.site) == ("Jane", "Doe", "Acme, Inc", "jane@x.fr", "+33 6 12", "https://linkedin.com/in/jane", "https://x.fr")
    assert (b.prenom, b.nom) == ("", "Prince")


def test_rss(spark, tmp_path):
    p = tmp_path / "d.xml"
    p.write_text("<rss><channel><item><title>T</title><link>http://x/1</link></item><item><title/><link>http://x/2</link></item></channel></rss>")
    assert [(r.guid, r.title) for r in files.read_rss(spark, str(p)).collect()] == [("http://x/1", "T")]


def test_sniff(spark):
    df = spark.createDataFrame([("a.bin", bytearray(b"PK\x03\x04")), ("a.txt", bytearray(b"BEGIN:VCARD\n")), ("a.txt", bytearray(b"x;y"))], "p string, c binary")
    assert [r[0] for r in df.select(files.sniff(F.col("p"), F.col("c"))).collect()] == ["xlsx", "vcf", "csv"]


def test_robots(spark):
    text = "User-agent: *\nDisallow: /\n\nUser-agent: crawl\nUser-agent: crawlbot\nDisallow: /a*b$\nAllow: /a/ok # fine\nDisallow: /a/\n"
    df = spark.createDataFrame([("/a/x",), ("/a/ok",), ("/a/ok/b",), ("/z",)], "p string")
    got = [r[0] for r in df.select(files.robots_allowed(F.col("p"), text, "CrawlBot/1.0")).collect()]
    assert got == [False, True, True, True]
    assert not df.limit(1).select(files.robots_allowed(F.col("p"), text, "other")).first()[0]


def test_points(spark):
    df = spark.createDataFrame([(1, {"name": "N", "contact:phone": "01", "url": "x.fr", "ref:FR:SIRET": "12345678901234"}, 1.0, 2.0)], "osm_id long, tags map<string,string>, lat double, lng double")
    r = files.read_points(df).first()
    assert (r.nom, r.phone, r.website, r.siren, r.email) == ("N", "01", "x.fr", "123456789", None)


def test_paged(spark):
    spark.dataSource.register(PagedSource)
    os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(__file__), os.environ.get("PYTHONPATH", "")])
    import sys

    sys.path.insert(0, os.path.dirname(__file__))
    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(__file__), "paged_fixture.py"))
    read = lambda f: spark.read.format("paged").option("fetch", f"paged_fixture:{f}").option("columns", "id string, name string").load()
    assert sorted((r.id, r.name) for r in read("fetch").collect()) == [("1", "a"), ("2", "b"), ("3", None), ("4", "d, e")]
    with pytest.raises(Exception, match="edition"):
        read("fetch_changing").collect()


def test_paged_stops_aloud(spark):
    read = lambda **o: spark.read.format("paged").option("fetch", "paged_fixture:fetch").option("columns", "id string, name string").options(**o).load().count()
    assert read() == 4
    with pytest.raises(Exception, match="more than 1 pages"):
        read(pages="1")
    assert read(pages="1", partial="true") == 2
    assert read(cursor="p2") == 2


def test_rss_caps_each_file(spark, tmp_path):
    for name, n in (("a", 3), ("b", 1)):
        items = "".join(f"<item><title>T{i}</title><link>http://{name}/{i}</link></item>" for i in range(n))
        (tmp_path / f"{name}.xml").write_text(f"<rss><channel>{items}</channel></rss>")
    assert sorted(r.guid for r in files.read_rss(spark, str(tmp_path), 2).collect()) == ["http://a/0", "http://a/1", "http://b/0"]
