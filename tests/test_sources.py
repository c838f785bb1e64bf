import json
import os

import pytest
from pyspark.sql import functions as F

from sitegraph.operators.normalize import dedupe_companies, job_ack, normalize_companies, submission_summary
from sitegraph.sources.companies import ColumnResolutionError, csv_records, resolve_columns, scan_companies
from sitegraph.sources.sinks import write_results_csv, write_status_json

EDGE_CSV = '''Company,Website,Note
 Acme ,acme.com,kept
ACME,ACME.com,dropped
Acme,https://acme.com/x,kept
,x.com,dropped
"  ",y.com,dropped
NA,na.com,kept
Bolt,HTTP://bolt.com,kept
"Q ""x""",q.com,kept
12,n.com,kept
'''


@pytest.mark.parametrize("header,expected", [
    (["Company", "Website"], ("Company", "Website")),
    (["COMPANY", "Company", "website"], ("Company", "website")),
    (["Org Name", "Site"], ("Org Name", "Site")),
    (["Full name", "Organization", "Home URL"], ("Full name", "Home URL")),
    (["Website Name", "Url"], ("Website Name", "Website Name")),
])
def test_resolve_columns(header, expected):
    assert resolve_columns(header) == expected


def test_resolve_columns_error():
    with pytest.raises(ColumnResolutionError, match=r"\['Firm', 'Link'\]"):
        resolve_columns(["Firm", "Link"])


def test_scan_normalize_dedupe(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "companies.csv").write_text(EDGE_CSV)
    (d / "notes.txt").write_text("Company,Website\nZ,z.com\n")
    raw = scan_companies(spark, str(d))
    kept = dedupe_companies(normalize_companies(raw)).orderBy("_ord").collect()
    assert [(r.company, r.website_url) for r in kept] == [
        ("Acme", "https://acme.com"), ("Acme", "https://acme.com/x"), ("NA", "https://na.com"),
        ("Bolt", "https://HTTP://bolt.com"), ('Q "x"', "https://q.com"), ("12", "https://n.com")]
    ack = job_ack(dedupe_companies(normalize_companies(raw)), "s1")
    ids = [r["Job ID"] for r in ack.collect()]
    assert len(set(ids)) == 6 and all(i.startswith("job_") and len(i) == 68 for i in ids)
    assert [tuple(r) for r in submission_summary(ack).collect()] == [("processing", 6, "Processing 6 companies")]


def test_csv_only_guard(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "companies.CSV").write_text("Company,Website\nA,a.com\n")
    with pytest.raises(ValueError):
        scan_companies(spark, str(d))


def test_write_results_csv_roundtrip(spark, tmp_path):
    rows = spark.createDataFrame([("A, Inc", "https://a", 'x "y"', None), ("B", "https://b", "", "ok")],
                                 "Company string, Website string, `Sitemap Complete` string, "
                                 "`Insight from Prompt` string")
    out = tmp_path / "res"
    write_results_csv(rows, str(out))
    text = "".join(open(os.path.join(out, f)).read() for f in sorted(os.listdir(out)) if f.endswith(".csv"))
    assert text.splitlines()[0] == "Company,Website,Sitemap Complete,Insight from Prompt"
    assert '"A, Inc",https://a,"x ""y""",' in text
    empty = tmp_path / "empty"
    write_results_csv(rows.limit(0), str(empty))
    files = [f for f in os.listdir(empty) if f.endswith(".csv")]
    assert "".join(open(os.path.join(empty, f)).read() for f in files).strip() == \
        "Company,Website,Sitemap Complete,Insight from Prompt"


def test_write_status_json(spark, tmp_path):
    jobs = spark.createDataFrame(
        [("job_1", "complete", None, ("A", "https://a", "u", "i")), ("job_2", "error", "boom", None),
         ("job_3", "queued", None, None)],
        "job_id string, status string, message string, "
        "data struct<Company:string,Website:string,`Sitemap Complete`:string,`Insight from Prompt`:string>")
    out = tmp_path / "status"
    write_status_json(jobs.withColumn("seq", F.lit(1)), str(out))
    lines = [json.loads(x) for f in os.listdir(out) if f.startswith("part") for x in open(os.path.join(out, f))]
    merged = {k: v for d in lines for k, v in d.items()}
    assert merged == {"job_1": {"status": "complete", "data": {"Company": "A", "Website": "https://a",
                                                                "Sitemap Complete": "u", "Insight from Prompt": "i"}},
                      "job_2": {"status": "error", "message": "boom"}}


def test_multiline_cells(spark, tmp_path):
    d = tmp_path / "ml"
    d.mkdir()
    (d / "c.csv").write_text('Company,Website\n"Two\nLines",a.com\nB,b.com\n')
    rows = normalize_companies(scan_companies(spark, str(d), multiline=True)).orderBy("_ord").collect()
    assert [(r.company, r.website_url) for r in rows] == [("Two\nLines", "https://a.com"), ("B", "https://b.com")]


def test_multiline_records_are_found_by_many_tasks(spark, tmp_path):
    import csv
    import random

    r = random.Random(5)
    cell = lambda: "".join(r.choice(["a", "é", '"', "\n", ",", " ", "x\r\ny", "\n\n", "'", "long text "]) for _ in range(r.randint(0, 40)))
    rows = [(f"c{i}", cell() or "-", f"w{i}.com{cell()}") for i in range(1500)]
    rows[700] = ("c700", "z\n" * 20_000, "w700.com")  # over several splits
    d = tmp_path / "in"
    d.mkdir()
    with open(d / "big.csv", "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, quoting=csv.QUOTE_ALL, lineterminator="\n")
        w.writerow(["Company", "Note\nof two lines", "Website"])
        w.writerows(rows)
    (d / "other.csv").write_bytes(b'\xef\xbb\xbfHome URL,Organization\r\nb.com,"Bolt\r\n& Co"\r\n\r\nd.com,Dee')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        records = csv_records(spark, str(d))
        assert records.select("block").distinct().count() > 20
        got = [(x.company, x.website) for x in scan_companies(spark, str(d), multiline=True).orderBy("_ord").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(a, c) for a, _, c in rows] + [("Bolt\r\n& Co", "b.com"), ("Dee", "d.com")]
    whole = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(str(d / "big.csv"))
    assert [(x[0], x[2]) for x in whole.collect()] == got[:1500]
