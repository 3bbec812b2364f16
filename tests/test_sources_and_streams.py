import json

from citeloom.sources import files, rest, schemas
from citeloom.streaming import incremental


def test_paged_search_reads_landed_pages(spark, tmp_path):
    for i in range(3):
        hits = [{"caseName": f"A{i}{j}", "cluster_id": j, "opinions": [{"id": 10 * i + j, "plain_text": "x" * 120}] if j else []} for j in range(2)]
        (tmp_path / f"p{i}.json").write_text(json.dumps({"results": hits}))
    hits = rest.search(spark, limit=5, pages=str(tmp_path))
    assert hits.count() == 5
    assert {r["case_id"] for r in files.flatten_hits(rest.search(spark, limit=50, pages=str(tmp_path))).collect()} == {1, 11, 21}


def test_retry_waits_and_gives_up():
    waits, replies = [], [(429, ""), OSError(), (200, '{"a": 1}')]

    def get(_):
        r = replies.pop(0)
        if isinstance(r, Exception):
            raise r
        return r

    assert rest.fetch_with_retry("u", get, sleep=waits.append) == {"a": 1} and waits == [60, 20]
    assert rest.fetch_with_retry("u", lambda _: (404, ""), sleep=waits.append) is None


def test_lookup_leaves_out_misses(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "k string")
    assert [tuple(r) for r in rest.looked_up(df, "k", "k string, v bigint", lambda k: {"v": 1} if k == "a" else None, 0).collect()] == [("a", 1)]


def test_upsert_and_scores_round_trip(spark, tmp_path):
    p = str(tmp_path / "t")
    files.upsert_parquet(spark, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), p, ["k"])
    files.upsert_parquet(spark, spark.createDataFrame([(2, "c")], "k int, v string"), p, ["k"])
    assert sorted(map(tuple, spark.read.parquet(p).collect())) == [(1, "a"), (2, "c")]
    row = {f.split()[0].strip("`"): None for f in schemas.RAW_SCORES.split(", ")} | {"benchmark_id": 1, "exists": True, "rrf_score": 0.5}
    files.write_scores(spark.createDataFrame([tuple(row.values())], schemas.RAW_SCORES), str(tmp_path / "s"))
    r = files.read_scores(spark, str(tmp_path / "s")).first()
    assert r["exists"] is True and r["rrf_score"] == 0.5 and r["label"] is None


def test_json_array_scan(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"caseName": "x", "opinions": None}, {"caseName": None}]))
    assert files.read_json_array(spark, str(tmp_path / "a.json"), schemas.RAW_HIT).count() == 2


def test_resume_skips_done_keys(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string").write.parquet(src)
    each = incremental.resume(out, "k", lambda b: b)
    run = lambda: incremental.run_available(spark.readStream.schema("k int, v string").parquet(src), "", str(tmp_path / "cp"), each)
    run()
    spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string").write.mode("append").parquet(src)
    run()
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_repeats_are_dropped_within_the_watermark(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.sql("select * from values ('a', timestamp'2024-01-01'), ('a', timestamp'2024-01-02'), ('b', timestamp'2024-01-02') t(text, at)").write.parquet(src)
    s = incremental.first_seen(spark.readStream.schema("text string, at timestamp").parquet(src), "at")
    incremental.run_available(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
