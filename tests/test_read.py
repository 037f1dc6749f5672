from cairn.operators.read import related_files


def test_a_file_behind_a_large_folder_is_related(spark, tmp_path):
    ids = ["repo/a.py", *(f"repo/b/f{i:04}.py" for i in range(450)), "repo/z.py"]
    spark.createDataFrame([(i,) for i in ids], "file_id string").write.parquet(str(tmp_path / "files.parquet"))
    rows = related_files(spark, str(tmp_path)).collect()
    assert len(rows) == 10 and tuple(rows[0]) == ("repo/z.py", 4, 452)
