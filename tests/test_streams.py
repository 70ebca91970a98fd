"""Request-log stream, keyword prompts and event-time accuracy: malformed lines,
repeated and null requests, late rows, replayed batches."""
import datetime as dt

from cohera.operators import keywords as KW
from cohera.sources import files as FS
from cohera.streaming import jobs as ST

HEADER = "product_title,review_text,max_len,n_sequences,output,flag,username,ts\n"


def _log(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(HEADER + "".join(f"{x}\n" for x in lines))


def test_request_log_stream_tells_malformed_lines(spark, tmp_path):
    src = tmp_path / "log"
    _log(src, "a.csv", "'Tea, green','nice\ntwo lines',50,1,,,u1,2021-11-30 10:00:00", "T,short", "T,x,50,1,,,u2,t,more,fields")
    _log(src, "b.csv", "T,'it''s',many,1,,,u3,2021-11-30 10:00:00", "T,x,60,2,,,u4,no time")
    ST.append_parquet(FS.stream_request_log(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = FS.read_request_log(spark, str(src), malformed=True)
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))
    rows = {r["username"]: r for r in got.collect()}
    assert {r["malformed"] is not None for r in got.collect()} == {True, False}
    assert rows["u1"]["review_text"] == "nice\ntwo lines" and rows["u1"]["malformed"] is None
    assert rows["u3"]["max_len"] is None and "many" in rows["u3"]["malformed"]
    assert rows["u4"]["ts"] is None and rows["u4"]["malformed"] is None  # a time is read later: null, not malformed
    assert got.where("malformed is not null").count() == 3


def test_prompts_of_arriving_requests(spark, tmp_path):
    docs = spark.createDataFrame([("1", "green tea taste"), ("2", "black coffee taste"), ("3", "coffee")], "id string, text string")
    idf = KW.fit_tfidf(docs, "id", "text")
    src = tmp_path / "log"
    _log(src, "a.csv", "Tea,green tea tea,50,1,,,u1,", "Cup,green tea tea,50,1,,,u2,", "Cup,green tea tea,50,1,,,u2,")
    _log(src, "b.csv", ",unseen words,50,1,,,u3,", "Nil,,50,1,,,u4,", "bad line")
    for _ in range(2):  # the second run finds nothing new
        ST.stream_prompts(FS.stream_request_log(spark, str(src)), idf, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = sorted((r["username"], r["prompt"]) for r in spark.read.parquet(str(tmp_path / "out/prompts")).collect())
    assert got == [("u1", "[BOS]Tea[SEP] tea green[SEP]"), ("u2", "[BOS]Cup[SEP] tea green[SEP]"),
                   ("u2", "[BOS]Cup[SEP] tea green[SEP]"), ("u3", "[BOS][SEP][SEP]"), ("u4", "[BOS]Nil[SEP][SEP]")]
    assert spark.read.parquet(str(tmp_path / "out/malformed")).count() == 1


def test_prompts_broadcast_nothing(spark):
    """A micro-batch passes neither the idf table nor its texts through the driver."""
    docs = spark.createDataFrame([("1", "green tea taste"), ("2", "black coffee taste")], "id string, text string")
    idf = KW.fit_tfidf(docs, "id", "text")
    requests = spark.createDataFrame([("Tea", "green tea tea", "u1")], "product_title string, review_text string, username string")
    out = ST.request_prompts(requests, idf)
    assert [r["prompt"] for r in out.collect()] == ["[BOS]Tea[SEP] tea green[SEP]"]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_event_time_accuracy_drops_late_rows_and_keeps_versions(spark, tmp_path):
    schema = "pair_id string, n_windows int, pos array<string>, neg array<string>, ts timestamp"
    src, sink, ck = (str(tmp_path / d) for d in ("in", "out", "ck"))
    good, bad = ["the tea leaf", "the tea cup", "the tea pot"], ["some words", "other things", "nothing shared"]
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(src)
        ST.stream_window_accuracy(ST.file_stream(spark, src, schema), sink, ck, "ts", watermark="30 minutes")

    def totals():
        return {(str(r["window_start"])[11:13], r["n_windows"]): (r["n_pairs"], r["n_correct"]) for r in ST.latest_windows(spark, sink).collect()}

    arrive(("p1", 1, good, bad, at(0)), ("p2", 1, bad, bad, at(0, 10)))
    assert totals() == {("00", 1): (2, 1)}
    arrive(("p3", 1, good, bad, at(0, 50)), ("p4", 2, good, bad, at(1)))  # out of order within the watermark
    assert totals() == {("00", 1): (3, 2), ("01", 2): (1, 1)}
    arrive(("p5", 1, good, bad, at(5)))
    arrive(("p6", 1, good, bad, at(6)))
    want = {("00", 1): (3, 2), ("01", 2): (1, 1), ("05", 1): (1, 1), ("06", 1): (1, 1)}
    assert totals() == want
    arrive(("p7", 1, good, bad, at(0, 20)), ("p8", 1, good, bad, at(6, 5)))  # p7 is hours late
    assert totals() == {**want, ("06", 1): (2, 2)}
    ids = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "out").glob("batch_id=*"))
    spark.read.parquet(f"{sink}/batch_id={ids[-1]}").write.parquet(f"{sink}/batch_id={ids[-1] + 1}")  # a repeated version changes nothing
    assert totals() == {**want, ("06", 1): (2, 2)}
