import corpus_pipeline as P


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in P.STAGES] == ["quality", "near_dedup", "secrets", "mixing", "byte_bpe"]
    good = P.good_documents(spark, docs, sf).cache()
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    once = P.without_near_copies(spark, good, sf).cache()
    assert once.columns == docs.columns and once.select("text").distinct().count() == once.count() <= good.count()
    rows = P.run(spark, sf).select("doc_id", "n_tokens", "round_trip").collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in once.select("doc_id").collect()}
    assert all(r.round_trip and r.n_tokens > 0 for r in rows)


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs_out = stage(spark, docs, sf)
        assert docs_out.count() == 0


CLASHES = "score double, keep string, _key string, key long, _mix_source string, mix_source int, mix_end int, n_tokens string, token_ids array<int>, round_trip int, content string, `a.b` string"


def test_clashing_columns_nulls_and_repeats(spark, sf, tmp_path):
    """The whole pipeline on columns named as its own ones, null ids, texts and sources, and repeated rows."""
    base = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in base]
    rows += [(None, base[0].text, "en", None, 3), (None, None, None, None, None), (None, None, None, None, None), (9001, None, "en", "x", 0), (9002, "", "en", "x", 0), (9003, " \n", None, "x", 2)]
    rows += [(9004, "token=abcdefghijkl0123 and some quiet words of an honest text", "en", "x", 60)] * 3 + [(9004, "another honest text with the same id as a repeated one", "en", "y", 54)]
    mine = (7.0, "mine", "k", 5, "ms", 6, 7, "nt", [1, 2], 8, "c", "dot")
    docs = spark.createDataFrame([(*r, *mine) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    own = [f"`{c}`" for c in docs.columns[5:]]
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.schema == docs.schema
        assert {repr(tuple(r)) for r in out.select(*own).collect()} == {repr(mine)}
    once = P.without_near_copies(spark, docs, str(tmp_path)).collect()
    assert sum(r.doc_id == 9004 for r in once) == 2 and sum(not (r.text or "").strip() for r in once) == 1
    out = P.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "n_tokens_", "token_ids_", "token_offsets", "round_trip_"]
    got = out.collect()
    assert got and all(r["round_trip_"] and r["n_tokens"] == "nt" and r["token_ids"] == [1, 2] and r["n_tokens_"] == len(r["token_ids_"]) for r in got)
