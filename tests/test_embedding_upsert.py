from citeloom.plans import corpus_queries as Q


def test_latest_embedding_of_every_chunk(spark, tmp_path):
    rows = [
        (3, 1, 0, "2024-01-05"), (9, 1, 1, "2024-03-02"), (2, 1, 1, "2024-02-01"),  # 3 and 9: odd and divisible by 3
        (4, 2, 0, "2024-03-04"), (8, 2, 0, "2024-01-04"), (5, 3, 0, "2024-01-01"), (6, 3, 0, "2024-01-02"), (7, 4, 2, None),
        (11, 5, 0, "2024-03-01"), (12, 5, 0, "2024-03-01"),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, case_id bigint, chunk_index int, t string")
    df.selectExpr("vec_id", "case_id", "chunk_index", "cast(t as timestamp) as embedded_at").write.parquet(f"{tmp_path}/embeddings_chunked.parquet")
    got = sorted((r["case_id"], r["chunk_index"], r["vec_id"]) for r in Q.embedding_upsert(spark, str(tmp_path)).collect())
    assert got == [(1, 0, 3), (1, 1, 9), (2, 0, 4), (3, 0, 6), (4, 2, 7), (5, 0, 12)]
