import pytest
from pyspark.sql import functions as F

from quillstream.plans import pipeline as P
from quillstream.plans.request import RequestError, check, cleanup_options, encode, in_testament, option, parse, unicode_form, AUDIO_KINDS
from quillstream.streaming import monitor, queue

BASE = {"is_new": True, "dataset_name": "d", "username": "u", "bible_id": "abcXYZ"}


def test_defaults_and_names():
    r = check(BASE)
    assert r["testament"]["nt"] and r["testament"]["ot"] and r["detail"]["lines"] and r["text_data"]["no_text"] and r["timestamps"]["no_timestamps"]
    assert r["bible_id"] == "ABCXYZ" and r["language_iso"] == "abc"
    r = check(BASE | {"other": {"x": "f.csv"}}, {"other": "text_data", "x": "file"})
    assert r["text_data"]["file"] == "f.csv" and not r["text_data"]["no_text"]
    assert check(parse(encode(r)) | {"is_new": True})["text_data"]["file"] == "f.csv"


@pytest.mark.parametrize("more,message", [
    ({"nonsense": 1}, "unknown field"), ({"output": {"cvs": True}}, "unknown field"), ({"is_new": "yes"}, "expected bool"), ({"dataset_name": ""}, "required"),
    ({"bible_id": ""}, "bible_id or language_iso"), ({"text_data": {"file": "a", "no_text": True}}, "only one option"), ({"output": 3}, "expected a section"),
    ({"text_data": {"file": "a.csv"}, "timestamps": {"fa_align": True}}, "timestamps need audio"), ({"audio_data": {"file": "a"}, "timestamps": {"fa_verse": True}}, "need text"),
    ({"speech_to_text": {"base_asr": True}}, "speech to text needs audio"), ({"audio_encoding": {"mfcc": True}}, "audio encoding needs timestamps"), ({"text_encoding": {"fast_text": True}}, "text encoding needs text"),
    ({"audio_proof": {"html_report": True}}, "audio proof"), ({"is_new": False, "audio_proof": {"html_report": True}}, "needs base_dataset"), ({"database": {"remote": "x"}}, "can't be new"),
    ({"compare": {"compare_settings": {"hyphen": {"remove": True, "normalize": True}}}}, "only one option"), ({"training": {"adapter": {"num_epochs": 3}, "no_training": True}}, "training"),
])
def test_errors(more, message):
    with pytest.raises(RequestError, match=message):
        check(BASE | more)


def test_options():
    r = check(BASE | {"audio_data": {"catalog": {"mp3_64": True, "set_type_code": "x"}}, "text_data": {"file": "a"}, "timestamps": {"fa_align": True}, "testament": {"nt_books": ["kar"]}, "compare": {"compare_settings": {"lower_case": True, "hyphen": {"normalize": True}, "diacritical_marks": {"normalize_nfkd": True}}}})
    assert option(r["audio_data"], AUDIO_KINDS) == "MP3 64kbps" and r["detail"]["words"]
    assert in_testament(r, "NT", "kar") and not in_testament(r, "NT", "LUM") and not in_testament(r, "OT", "KAR")
    assert cleanup_options(r)["hyphens"] == "normalize" and unicode_form(r) == "NFKD"
    with pytest.raises(RequestError):
        parse("a: [")
    with pytest.raises(RequestError):
        parse("- 1")


def test_run_and_compare(spark, tmp_path):
    root, out = str(tmp_path / "root"), tmp_path / "out"
    out.mkdir()
    for name, text in (("one", "The cat sat here."), ("two", "The kitten sat here.")):
        (tmp_path / f"{name}.csv").write_text(f'book,chapter,verse,text\nKAR,1,1,"{text}"\nKAR,1,2,"Same line"\n')
    run = lambda name, **more: P.run_request(spark, check({"is_new": True, "dataset_name": name, "username": "u", "language_iso": "eng", "text_data": {"file": str(tmp_path / f"{name}.csv")}, "detail": {"words": True}, **more}), root)
    a = run("one")
    assert a["scripts"].count() == 2 and [r.word for r in a["words"].orderBy("word_id").limit(3).collect()] == ["The", " ", "cat"]
    b = run("two", compare={"base_dataset": "one", "html_report": True, "compare_settings": {"lower_case": True, "remove_punctuation": True}}, output={"directory": str(out), "csv": True, "json": True, "parquet": True})
    rows = b["pairs"].collect()
    assert [r.ref for r in rows] == ["KAR 1:1"] and "<del>" in rows[0].html
    assert (out / "compare.html").exists() and spark.read.parquet(str(out / "scripts.parquet")).count() == 2
    with pytest.raises(RequestError):
        P.run_request(spark, check({"dataset_name": "none", "username": "u", "language_iso": "eng"}), root)
    plug = P.Plugins(align=lambda w: w.withColumn("fa_score", F.lit(0.5)), transcribe=lambda s: s.withColumn("script_text", F.lit("heard")))
    c = P.run_request(spark, check({"dataset_name": "one", "username": "u", "language_iso": "eng", "audio_data": {"file": "x.mp3"}, "text_data": {"file": str(tmp_path / "one.csv")}, "timestamps": {"fa_align": True}, "speech_to_text": {"base_asr": True}}), root, plug)
    assert c["words"].filter("fa_score = 0.5").count() == c["words"].count() and c["heard"].first().script_text == "heard"
    store = P.Store(spark, root, "u", "one")
    assert store.exists("scripts")
    store.drop()
    assert not store.exists() and store.read("chars").count() == 0


def test_queue(spark, tmp_path):
    for d in ("in", "res"):
        (tmp_path / d).mkdir()
    (tmp_path / "in/a.yaml").write_text("dataset_name: a\nusername: u\nlanguage_iso: eng\n")
    (tmp_path / "in/b.yaml").write_text("dataset_name: b\n")
    (tmp_path / "in/c.yaml").write_text("dataset_name: c\nusername: u\nlanguage_iso: eng\n")
    seen = []

    def run(r):
        seen.append(r["dataset_name"])
        if r["dataset_name"] == "c":
            raise RuntimeError("broken")

    q = queue.serve(spark, str(tmp_path / "in"), str(tmp_path / "cp"), run, str(tmp_path / "res"))
    q.awaitTermination(120)
    codes = {r.path.rsplit("/", 1)[1]: r.code for r in spark.read.parquet(str(tmp_path / "res")).collect()}
    assert codes == {"a.yaml": 200, "b.yaml": 400, "c.yaml": 500} and sorted(seen) == ["a", "c"]


def test_monitor(spark, tmp_path):
    rows = [(i, f"2024-01-01 {h:02d}:{m:02d}:00", 1, "click", 1.5) for i, (h, m) in enumerate([(1, 0), (1, 10), (2, 30), (9, 0)])]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    path = str(tmp_path / "events.parquet")
    hours = monitor.run_once(spark, monitor.hourly_activity(monitor.event_stream(spark, path)), "h").orderBy("hour").collect()
    assert [(r.hour.hour, r.n, r.cents) for r in hours] == [(1, 2, 300), (2, 1, 150)]
    sessions = monitor.run_once(spark, monitor.user_sessions(monitor.event_stream(spark, path)), "s").orderBy("begin_at").collect()
    assert [(r.n, r.end_at.minute) for r in sessions] == [(2, 40), (1, 0)]
