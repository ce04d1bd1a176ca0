"""Sources, sinks and streams."""

import json
import zipfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from paigham.config import Settings
from paigham.operators import bayes, quality, rules, scanlog
from paigham.plans.pipeline import EmptyDatasetError, Pipeline, score
from paigham.sources import readers, sinks, stored
from paigham.streaming import scan


def write(tmp_path, text, name="log.json"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


GOOD = {"id": 1, "prediction": "Scam", "confidence": 80.5, "timestamp": "2024-03-01T00:00:00+00:00"}


def test_scan_log_reads(spark, tmp_path):
    assert readers.load_scan_log(spark, str(tmp_path / "none.json")).count() == 0
    assert readers.load_scan_log(spark, write(tmp_path, "  ")).count() == 0
    assert readers.load_scan_log(spark, write(tmp_path, "[]")).count() == 0
    got = readers.load_scan_log(spark, write(tmp_path, chr(0xFEFF) + json.dumps([GOOD, GOOD | {"id": 2, "confidence": None}])))
    assert [(r["id"], r["confidence"]) for r in got.orderBy("id").collect()] == [(1, 80.5), (2, None)]


@pytest.mark.parametrize(
    "text",
    ["{}", json.dumps([{"id": 1}]), json.dumps([GOOD | {"id": 0}]), json.dumps([GOOD | {"id": True}]), json.dumps([GOOD, GOOD]), json.dumps([GOOD | {"prediction": "x"}]), json.dumps([GOOD | {"confidence": 101}]), json.dumps([GOOD | {"timestamp": "soon"}]), json.dumps([GOOD | {"more": 1}]), json.dumps([GOOD]) + "garbage"],
)
def test_scan_log_refuses(spark, tmp_path, text):
    path = write(tmp_path, text)
    with pytest.raises(readers.ScanLogError):
        readers.load_scan_log(spark, path)
    assert open(path, encoding="utf-8").read() == text


def test_messages_from_csv(spark, tmp_path):
    path = write(tmp_path, 'msg,status,source,more\n"two\nlines, ""quoted""",Scam,Real,1\n', "m.csv")
    df = readers.load_messages(spark, path)
    assert df.columns == ["msg", "status", "source"] and df.first()["msg"] == 'two\nlines, "quoted"'
    for bad in (str(tmp_path / "no.csv"), write(tmp_path, "x", "m.txt"), write(tmp_path, "a,b\n1,2\n", "n.csv")):
        with pytest.raises(readers.DatasetError):
            readers.load_messages(spark, bad)
    assert readers.from_rows(spark, "one").count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"\nb', "train"), (2, "č", "test")], "row_id bigint, msg string, split string")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert readers.read_csv(spark, str(tmp_path / "c"), "row_id bigint, msg string, split string").exceptAll(df).isEmpty()
    sinks.write_splits(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("split = 'test'").count() == 1
    log = str(tmp_path / "log")
    sinks.append_log(df, log)
    sinks.append_log(df, log)
    sinks.compact(spark, log)
    assert spark.read.parquet(log).count() == 4
    assert sinks.export_csv(df.limit(0), str(tmp_path)) is None
    assert sinks.export_csv(df, str(tmp_path)).endswith(".csv")
    assert "č" in sinks.report_json(df.where("row_id = 2"))


def test_streams(spark, tmp_path):
    feed = str(tmp_path / "feed")
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).select(F.col("id"), F.col("id").alias("row_id"), F.when(F.col("id") % 2 == 0, "Scam").otherwise("Genuine").alias("prediction"), F.lit(50.0).alias("confidence"), F.lit("2024-03-01T00:00:00").alias("scanned_at"), F.timestamp_seconds(F.col("id") * 3600).alias("logged_at")).coalesce(1).write.mode("append").parquet(feed)
    scan.run_once(scan.totals(scan.read_log(spark, feed, files_per_trigger=1)), "totals", "complete", str(tmp_path / "c1"))
    assert spark.table("totals").first().asDict() == {"total": 30, "scam": 15}
    errors = []
    out = str(tmp_path / "out")
    scored = lambda b: b.select("id", F.when(F.col("id") % 3 == 0, 200).otherwise(422).alias("status"))
    scan.append_scored(scan.read_log(spark, feed), scored, out, str(tmp_path / "c2"), errors.append).awaitTermination()
    assert spark.read.parquet(out).count() == 10 and not errors
    # A sink that fails is reported, scoring that fails stops the stream and the batch is taken again.
    blocked = write(tmp_path, "x", "a_file")
    scan.append_scored(scan.read_log(spark, feed), scored, f"{blocked}/below", str(tmp_path / "c3"), errors.append).awaitTermination()
    assert len(errors) == 1
    late = str(tmp_path / "late")
    with pytest.raises(Exception, match="missing"):
        scan.append_scored(scan.read_log(spark, feed), lambda b: b.select("missing"), late, str(tmp_path / "c6"), errors.append).awaitTermination()
    assert len(errors) == 1
    scan.append_scored(scan.read_log(spark, feed), scored, late, str(tmp_path / "c6"), errors.append).awaitTermination()
    assert spark.read.parquet(late).count() == 10
    scan.keep_recent(scan.read_log(spark, feed), feed, str(tmp_path / "r"), str(tmp_path / "c4"), 5).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "r")).count() == 5
    scan.run_once(scan.windowed(scan.read_log(spark, feed, files_per_trigger=1)), "windows", "append", str(tmp_path / "c5"))


def workbook(path, sheets):
    """A workbook of the least parts: shared, inline, number, boolean and blank cells."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>msg</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>')
        for k, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    return str(path)


def test_worksheets(spark, tmp_path):
    text = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    header = f'<row><c r="A1" t="s"><v>0</v></c>{text("B1", "status")}{text("C1", "source")}{text("D1", "more")}</row>'
    rows = header + f'<row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>7</v></c></row><row/><row>{text("A4", "č &amp; d")}{text("B4", "Scam")}<c r="C4" t="b"><v>1</v></c></row>'
    path = workbook(tmp_path / "w.xlsx", {"empty": "", "data": rows})
    got = readers.load_messages(spark, path, "data")
    assert [tuple(r) for r in got.collect()] == [("two runs", None, "7"), ("č & d", "Scam", "TRUE")]
    for sheet in ("none", None):
        with pytest.raises(readers.DatasetError):
            readers.load_messages(spark, path, sheet)
    with pytest.raises(readers.DatasetError):
        readers.load_messages(spark, write(tmp_path, "not a workbook", "x.xlsx"))
    assert readers.load_messages(spark, path, "data", {"more": "other"}).columns == ["msg", "status", "source"]


RAW = [(i, f"win prize item{chr(97 + i)} now lottery", "Scam", "Real") for i in range(20)] + [(100 + i, f"class exam room{chr(97 + i)} today notes", "ham", "generated") for i in range(20)]


@pytest.fixture()
def raw(spark):
    return spark.createDataFrame(RAW, "row_id bigint, msg string, status string, source string")


def test_models_are_saved_and_checked(spark, raw, tmp_path):
    path = str(tmp_path / "m")
    model = Pipeline(raw, Settings(ngrams=1, stopwords=frozenset({"now"}))).model
    stored.save_model(model, path)
    loaded = stored.load_model(spark, path)
    assert loaded.settings == model.settings
    new = spark.createDataFrame([(1, "lottery prize"), (2, "exam notes"), (3, "zqx")], "row_id bigint, msg string")
    assert sorted(score(new, loaded).collect()) == sorted(score(new, model).collect())
    with pytest.raises(stored.ModelError, match="no model"):
        stored.load_model(spark, str(tmp_path / "none"))
    described = json.loads((tmp_path / "m" / "model.json").read_text())
    for change, match in (({"version": 9}, "version"), ({"labels": ["a"]}, "labels"), ({"terms": 1}, "number of terms"), ({"probe": {}}, "probe"), ({"settings": {"odd": 1}}, "unknown settings")):
        sinks.write_json(spark, f"{path}/model.json", described | change)
        with pytest.raises(stored.ModelError, match=match):
            stored.load_model(spark, path)
    sinks.write_json(spark, f"{path}/model.json", described)
    bayes.term_probabilities(raw.limit(0).withColumn("cleaned_msg", F.col("msg")), model.vocab).write.mode("overwrite").parquet(f"{path}/theta")
    with pytest.raises(stored.ModelError, match="terms"):
        stored.load_model(spark, path)
    with pytest.raises(stored.ModelError, match="lacks"):
        stored.load_vocabulary(spark, f"{path}/prior")


def test_json_takes_the_place_of_the_old(spark, tmp_path):
    path = str(tmp_path / "r.json")
    for value in ({"a": "č"}, [1, 2]):
        sinks.write_json(spark, path, value)
        assert json.loads((tmp_path / "r.json").read_text(encoding="utf-8")) == value
    with pytest.raises(ValueError):
        sinks.write_json(spark, path, float("nan"))
    assert json.loads((tmp_path / "r.json").read_text()) == [1, 2] and not [x for x in tmp_path.iterdir() if x.name.endswith(".tmp")]


def test_command(spark, tmp_path, capsys, monkeypatch):
    from paigham import prepare

    monkeypatch.setattr(prepare, "local_session", lambda: spark)
    path = write(tmp_path, "msg,status,source\n" + "\n".join(f"{m},{s},{o}" for _, m, s, o in RAW), "m.csv")
    out = tmp_path / "out"
    assert prepare.main(["--file", path, "--out", str(out), "--strict", "--unigrams"]) == 0
    shown = capsys.readouterr().out
    assert '"total_rows": 40' in shown and "- win prize" in shown
    assert {x.name for x in out.iterdir()} >= {"cleaned.csv", "train.csv", "test.csv", "vocabulary", "model", "report.json"}
    assert readers.read_csv(spark, str(out / "cleaned.csv")).columns == ["msg", "cleaned_msg", "status", "source"]
    train, test = (readers.read_csv(spark, str(out / f"{x}.csv")) for x in ("train", "test"))
    assert train.columns == test.columns == ["msg", "cleaned_msg", "status"] and train.count() + test.count() == readers.read_csv(spark, str(out / "cleaned.csv")).count()
    assert not stored.load_vocabulary(spark, str(out / "vocabulary")).where(F.col("term").contains(" ")).count()
    assert json.loads((out / "report.json").read_text())["files"]["train"].endswith("train.csv")
    assert prepare.main(["--file", path, "--no-save", "--quiet", "--out", str(tmp_path / "none")]) == 0
    assert "- win" not in capsys.readouterr().out and not (tmp_path / "none").exists()
    assert prepare.main(["--file", str(tmp_path / "no.csv")]) == 1
    assert prepare.main(["--file", write(tmp_path, "msg,status,source\n!!,Scam,x\n", "e.csv")]) == 1


def test_nothing_left_is_an_error(raw):
    for left in (raw.limit(0), raw.withColumn("msg", F.lit("!!")), raw.withColumn("status", F.lit("odd"))):
        with pytest.raises(EmptyDatasetError):
            Pipeline(left).cleaned


def test_split_of_a_single_row_of_a_label(raw):
    p = Pipeline(raw.where("row_id < 101"))
    assert p.split.count() == p.cleaned.count() and {r["split"] for r in p.split.collect()} == {"train", "test"}


def test_differences_from_golden_rows(spark):
    ours = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d")], "row_id bigint, cleaned_msg string")
    golden = spark.createDataFrame([(1, "a"), (2, None), (3, "x"), (5, "e")], "row_id bigint, cleaned_msg string")
    got = sorted(map(tuple, quality.differences(ours, golden, "cleaned_msg").collect()))
    assert got == [(3, "c", "x"), (4, "d", None), (5, None, "e")]


def test_admission_of_requests(spark):
    rows = [(1, "salam dost", True, "Scam"), (2, "salam dost", False, "Scam"), (3, "salam dost", True, "odd"), (4, None, True, None), (5, "x" * 40_000, False, None)]
    df = spark.createDataFrame(rows, "i int, m string, j boolean, p string")
    status, _ = rules.admission(F.col("m"), F.col("m"), F.lit(1), is_json=F.col("j"), prediction=F.col("p"))
    assert [r[0] for r in df.orderBy("i").select(status).collect()] == [200, 415, 500, 400, 413]
    assert rules.batch_totals(df, "p").first().asDict() == {"total": 5, "scam": 2, "genuine": 3}


def test_tracker_without_state(spark, tmp_path):
    path = str(tmp_path / "t")
    zero = {"total_checked": 0, "scam_count": 0, "genuine_count": 0, "scam_percent": 0.0, "genuine_percent": 0.0}
    assert scanlog.tracker_summary(readers.load_tracker(spark, path)).first().asDict() == zero
    spark.createDataFrame([(1, "x", "Scam", 90, "HIGH")], readers.TRACKER).write.json(path)
    assert readers.load_tracker(spark, path).count() == 1
    sinks.reset_tracker(spark, path)
    assert scanlog.tracker_summary(readers.load_tracker(spark, path)).first().asDict() == zero


def test_settings_survive_storage():
    plain = stored._plain(replace(Settings(), max_features=7))
    assert stored._settings(json.loads(json.dumps(plain))) == replace(Settings(), max_features=7)


def test_cuts_are_deleted(spark):
    from pathlib import Path

    from paigham import storage

    kept, dropped = (storage.cut(spark.range(5)) for _ in range(2))
    folder = lambda df: Path(df.inputFiles()[0].removeprefix("file:").replace("//", "/")).parent
    first, second = folder(kept), folder(dropped)
    storage.drop_cut(dropped)
    assert first.exists() and not second.exists() and kept.count() == 5
    assert storage.drop_cuts(spark) >= 2 and not first.exists() and storage.drop_cuts(spark) == 0
