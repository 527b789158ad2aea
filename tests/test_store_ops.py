from conftest import rows

from kelpie.plans import catalogue


def test_code_chunks_keep_bodies_with_blank_lines(spark, tmp_path):
    chunks = [
        (1, 1, "a.py\n\ndef f():\n    return 1\n\n\ndef g():\n    return 2\n\n"), (2, 2, "b.txt\n\none\n\ntwo"), (3, 2, "no blank line"), (4, 2, "c.txt\n\n"), (5, 2, None),
    ]
    spark.createDataFrame(chunks, "id long, file_id long, embed_text string").write.parquet(f"{tmp_path}/code_chunks.parquet")
    spark.createDataFrame([(1, "a.py"), (2, "b.txt")], "id long, path string").write.parquet(f"{tmp_path}/indexed_files.parquet")
    got = rows(catalogue.QUERIES["J04_ast"](spark, str(tmp_path)), "id", "symbol", "first_line", "last_line")
    assert got == [(1, "f", 1, 2), (1, "g", 5, 6), (2, None, 1, 3), (3, None, 1, 1)]
