import time

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import checkpoints, files, providers
from corpusloom.streaming.resume import resume_stream


def test_files(spark, tmp_path):
    p = str(tmp_path)
    df = spark.createDataFrame([("1", "é", "x\ny"), ("2", "b", "z")], files.ARTICLE)
    files.write_jsonl(df, f"{p}/a")
    assert files.read_jsonl(spark, f"{p}/a", files.ARTICLE).exceptAll(df).isEmpty()
    files.write_json_array(df, "text", "id", f"{p}/arr")
    assert [r["value"] for r in files.read_json_array(spark, f"{p}/arr").orderBy("pos").collect()] == ["x\ny", "z"]
    files.write_words(df, "title", f"{p}/w")
    assert {r["w"] for r in files.read_words(spark, f"{p}/w").collect()} == {"b", "é"}
    assert files.read_words(spark, f"{p}/none").isEmpty()
    assert files.pick_shards(["a", "b", "c"], 2) == files.pick_shards(["c", "b", "a"], 2)
    assert files.local_dataset(spark, [f"{p}/none", f"{p}/a"]) == f"{p}/a"


def test_append_and_cache(spark, tmp_path):
    p = f"{tmp_path}/out"
    work = spark.range(5).withColumnRenamed("id", "k")
    assert files.append_missing(work.filter("k < 3"), p, "k") == 3
    assert files.append_missing(work, p, "k") == 2
    assert files.append_missing(work, p, "k") == 0
    c = files.cached_table(spark, f"{tmp_path}/c", work, "k", lambda d: d.withColumn("v", F.col("k") * 2))
    assert {tuple(r) for r in c.collect()} == {(i, 2 * i) for i in range(5)}


def test_checkpoints(spark, tmp_path):
    checkpoints.save_tables({"v": spark.range(10)}, str(tmp_path))
    assert checkpoints.load_tables(spark, str(tmp_path), ["v"])["v"].count() == 10
    assert checkpoints.folder_mb(spark, str(tmp_path)) > 0


def test_retries():
    calls = []

    def shaky(messages):
        calls.append(1)
        if len(calls) == 1:
            raise providers.TemporaryFailure("429")
        return ("", {}) if len(calls) == 2 else ("ok", {"in": 1})

    waits = []
    retry = providers.Retry(sleep=waits.append, chance=lambda: 0.5)
    assert retry.ask(shaky, []) == ("ok", {"in": 1}) and waits == [2, 6]
    assert all(1.5 <= w <= 2.5 for w in (next(providers.Retry().waits()) for _ in range(50)))
    quiet = providers.Retry(calls=3, sleep=lambda s: None)
    with pytest.raises(providers.TemporaryFailure, match="empty"):
        quiet.ask(lambda m: ("", {}), [])
    with pytest.raises(providers.TemporaryFailure, match="500"):
        quiet.ask(lambda m: (_ for _ in ()).throw(providers.TemporaryFailure("500")), [])


def test_event_stream(tmp_path, monkeypatch):
    lines = ['data: {"choices":[{"delta":{"content":"a"}}]}\n', "\n", ": ping", "", 'data: {"choices":', 'data: [],"usage":{"in":2}}', "", "data: [DONE]", "", "data: nothing"]
    assert providers.read_stream(lines) == ("a", {"in": 2}) and providers.read_stream([]) == ("", {})
    (tmp_path / ".env").write_text("KEY='v'\n")
    assert providers.setting("KEY", str(tmp_path / ".env")) == "v"


def test_rewrite(spark):
    df = spark.createDataFrame([("0_0", "the king goes"), ("0_1", "xx Rome")], "chunk_id string, text string")
    got = {r["chunk_id"]: r for r in providers.rewrite(df, providers.offline_provider(["the", "king", "it"]), ["the", "king", "it"], [], "s").collect()}
    assert got["0_0"]["answer"] == "the king" and got["0_0"]["accepted"] and got["0_1"]["answer"] == "it"


def test_rewrites_run_in_parallel_and_keep_their_order(spark):
    def slow(messages):
        import time

        time.sleep(0.2)
        return messages[-1]["content"].split(":")[-1].strip(), {"in": 1}

    df = spark.createDataFrame([(str(i), f"word{i}") for i in range(32)], "chunk_id string, text string").coalesce(1)
    start = time.perf_counter()
    rows = providers.rewrite(df, slow, [], [], "s", attempts=2).collect()
    assert [r["chunk_id"] for r in rows] == [str(i) for i in range(32)] and all(r["attempts"] == 2 and r["usage"] == {"in": 2} for r in rows)
    assert time.perf_counter() - start < 32 * 2 * 0.2


def test_resume_stream(spark, tmp_path):
    src, sink, chk = (f"{tmp_path}/{x}" for x in ("src", "sink", "chk"))
    rows = [("1", "a", "t"), ("2", "b", "t"), ("1", "a", "t")]
    spark.createDataFrame(rows, files.ARTICLE).coalesce(1).write.json(src)
    resume_stream(spark, src, files.ARTICLE, "id", sink, chk)
    spark.createDataFrame([("2", "b", "t"), ("3", "c", "t")], files.ARTICLE).coalesce(1).write.mode("append").json(src)
    resume_stream(spark, src, files.ARTICLE, "id", sink, chk)
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == ["1", "2", "3"]


def test_reports(tmp_path):
    from corpusloom.functions.text import system_prompt

    files.write_results({"part": {"bits": 1.25, "é": [1]}}, f"{tmp_path}/r.json")
    assert '"é"' in (tmp_path / "r.json").read_text()
    assert files.render("{a} of {b}", {"a": 0.5, "b": 1234}, {"a": ".1%", "b": ","}) == "50.0% of 1,234"
    assert files.percent(0.1234) == "12.3 %"
    assert system_prompt("{n} words: {list}", {"n": "2", "list": "a b"}) == "2 words: a b"
