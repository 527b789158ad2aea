from conftest import rows

from kelpie.llm import origin

FILES = "id long, project_id long, path string, language string, content_hash string, lines string"
CHUNKS = "id long, file_id long, kind string, embed_text string"
UPSTREAM = "upstream_id long, package_name string, content_hash string"

HAND = "def load(x):\n    if not x:\n        return None\n    return x.value + 1\n" * 4
TABLE = "DATA = [\n" + "\n".join(f"    {i}, {i * 7}, 0x{i:02x}, -{i}.5," for i in range(20)) + "\n]"
MINIFIED = "function a(b,c){return b.x(c<4?b:4)}var d=e=>e&&e.f||3;" * 30
BLOB = 'PAYLOAD = "' + "QmFzZTY0" * 90 + '"'
ACCESSORS = "\n".join(f"    def get_field_{i}(self): return self._fields[{i}]" for i in range(12))


def found(spark, *cases, extra_chunks=(), upstream=()):
    files = [(i, 1, path, language, digest, "clash") for i, (path, language, digest, _) in enumerate(cases)]
    chunks = [(i * 10, i, "k", f"{path}\n\n{body}") for i, (path, _, _, body) in enumerate(cases) if body is not None]
    df = origin.file_origins(spark.createDataFrame(files, FILES), spark.createDataFrame([*chunks, *extra_chunks], CHUNKS), spark.createDataFrame(list(upstream), UPSTREAM))
    return [r["origin"] for r in df.orderBy("file_id").collect()]


def test_layout(spark):
    assert found(
        spark, ("a/x.py", "py", "1", HAND), ("a/t.py", None, "2", TABLE), ("a/m.js", "JavaScript", "3", MINIFIED), ("a/b.py", "python", "4", BLOB), ("a/g.py", "python", "5", ACCESSORS),
        ("a/long.py", "python", "6", HAND * 3 + 'help = "' + "words and more words " * 40 + '"'), ("a/cases.py", "python", "7", HAND * 2 + "\n".join(f"    [{i}, 2, 3],  # case" for i in range(6))),
    ) == ["hand", "data", "minified", "data", "generated", "hand", "hand"]


def test_layout_of_parts(spark):
    licence = "// words of a licence that goes on for long\n" * 40
    few = "\n".join(f"let v{i} = read({i});" for i in range(5))
    assert found(
        spark, ("a/1.js", None, "1", licence + MINIFIED * 2), ("a/2.js", None, "2", few), ("a/3.rs", None, "3", "let a = 1;\nlet b = a + 1;\nlet c = f(b);"),
        ("a/4.go", None, "4", HAND + 'var text = "' + "a long text of many words that someone wrote " * 12 + '"'), ("a/5.cs", None, "5", " " * 40 + MINIFIED), ("a/6.java", None, "6", "int a = 1;" * 3),
    ) == ["minified", "generated", "hand", "hand", "minified", "hand"]
    assert set(origin.LIMITS) == set(origin.LANGUAGES)


def test_marks(spark):
    assert found(
        spark, ("a/1.py", None, "1", "# Code generated by tool. DO NOT EDIT.\n" + HAND), ("a/2.py", None, "2", "# Originally generated, maintained by hand since.\n" + HAND),
        ("a/3.py", None, "3", HAND + '\nout.write("# Code generated by x. DO NOT EDIT.")'), ("a/4.py", None, "4", "# SPDX: MIT\n# @generated by t\n" + HAND), ("a/5.py", None, "5", "# Please do not edit while it runs.\n" + HAND),
    ) == ["generated", "hand", "hand", "generated", "hand"]


def test_packages(spark):
    known = [(1, "ropelib", "beef"), (1, "ropelib", None), (2, None, "dead")]
    assert found(
        spark, ("x/vendor/ropelib/a.py", None, "1", HAND), ("x/vendor/a.py", None, "2", HAND), ("x/lib/ropelib-1.2.3/a.py", None, "3", HAND), ("./X\\Vendor\\RopeLib\\2.0.1\\a.PY", None, "4", HAND),
        ("x/vendors_list/ropelib/a.py", None, "5", HAND), ("x/b.py", None, "beef", HAND), ("x/c.py", None, "6", "# ropelib 1.2.3\n" + HAND), ("x/d.py", None, "7", "# Works with ropelib 1.2.3 and later.\n" + HAND),
        ("x/e.py", None, "8", "# unknown 1.2.3\n" + HAND), upstream=known,
    ) == ["vendored", "hand", "vendored", "vendored", "hand", "vendored", "vendored", "hand", "hand"]


def test_nulls_and_empty(spark):
    assert found(spark, (None, None, None, None), ("a.pb.go", None, None, None), ("a/e.py", None, "1", ""), extra_chunks=[(1, 2, "k", None), (2, None, "k", "x"), (3, 77, None, "x")]) == ["hand", "generated", "hand"]
    empty = origin.foreign_files(spark.createDataFrame([], FILES), spark.createDataFrame([], CHUNKS), spark.createDataFrame([], UPSTREAM))
    assert rows(empty) == []


def test_many_chunks_of_one_file(spark):
    chunks = [(i, 0, "k", "p\n\n" + MINIFIED) for i in range(500)]
    assert found(spark, ("a/x.js", None, "1", None), extra_chunks=chunks) == ["minified"]
