"""Verbs of the command line, what they print and their exit status; index files; scans of plain directories."""

import subprocess

import pytest
from pyspark.sql import functions as F

from lodestone.__main__ import main
from lodestone.functions.text import runtime_lines
from lodestone.operators import corpus
from lodestone.sources.index_files import read_index, read_manifest, same_manifest, with_shas, write_index
from lodestone.sources.worktree import scan_directory
from lodestone.streaming.refresh import Store


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in {
        "App/App.csproj": "", "App/Svc.cs": "[ServiceContract] interface ISvc { void Save(); }\nclass Svc : ISvc, Root<int> { public void Save() { } }\n", "App/Root.cs": "\nclass Root<T> { int total; }\n",
        "App/Gen.designer.cs": "class Made { }", "docs/a/note.txt": "Save one\n\nsave two Save\n" + "x\n" * 70, "docs/b/note.txt": "unsaved Saved\n", "docs/only.md": "Save\tthis",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    for args in (["init", "-q"], ["add", "."], ["-c", "user.name=t", "-c", "user.email=t@example.com", "commit", "-qm", "one"]):
        subprocess.run(["git", "-C", str(root), *args], check=True)
    return root


def test_verbs(spark, tree, tmp_path, capsys):
    call = lambda verb, *more: (main([verb, "--worktree", str(tree), "--store", str(tmp_path / "store"), *more], spark), capsys.readouterr().out)
    assert call("refresh") == (0, "")
    assert call("usages", "Save", "--no-text") == (0, "App/Svc.cs\t1\nApp/Svc.cs\t2\ndocs/a/note.txt\t1\ndocs/a/note.txt\t3\ndocs/only.md\t1\n")
    assert call("usages", "Save", "--scope", "docs", "--include", "*.md") == (0, "docs/only.md\t1\tSave\tthis\n")
    assert call("usages", "Nowhere") == (0, "")
    status, out = call("search", "Save", "total")
    assert status == 0 and out.splitlines()[0].split("\t")[0] == "App/Root.cs" and len(out.splitlines()[0].split("\t")[1].split(".")[1]) == 2
    assert call("search", "Nowhere") == (3, "")
    status, out = call("closure", "--scope", "App")
    assert status == 0 and [(r.split("\t")[1], r.split("\t")[-1]) for r in out.splitlines()[1:]] == [("Root`1", "1"), ("ISvc", "1"), ("Svc", "1"), ("total", "1"), ("Save", "1"), ("Save", "1")]
    status, out = call("declarations", "--kind", "class")
    assert status == 0 and "Svc : ISvc, Root<int>" in out and "Made" not in out and "[App]" in out and "Total: 2 declarations" in out
    status, out = call("declarations", "--kind", "class", "--max-results", "1")
    assert "Shown: 1." in out
    assert call("declarations", "--kind", "class,interface", "--include-generated", "--group-by", "kind", "--raw") == (0, "3\tclass\n1\tinterface\n")
    status, out = call("declarations", "--name", "Root", "--raw")
    assert out.split("\t")[:3] == ["class", "Root`1", ""]
    assert call("declarations", "--name", "Nowhere") == (3, "No declaration found.\n")
    assert call("declarations")[0] == 1 and call("closure")[0] == 1 and main(["other"], spark) == 1
    status, out = call("summarize", "a/note.txt", "--head", "3", "--tail", "1")
    assert status == 2
    assert call("summarize", "docs/a/note.txt", "--head", "3", "--tail", "1") == (0, "=== docs/a/note.txt (73 lines) ===\n\nSave one\n\nsave two Save\n\n--- [ 69 lines left out ] ---\n\nx\n")
    assert call("summarize", "ONLY.md") == (0, "=== docs/only.md (1 lines) ===\n\nSave\tthis\n")
    assert call("summarize", "none.md")[0] == 1
    assert call("prune")[0] == 0
    assert main(["refresh", "--worktree", str(tmp_path), "--store", str(tmp_path / "s2")], spark) == 2


def test_index_files(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.refresh(str(tree))
    decl = store.declarations(str(tree))
    write_index(decl, str(tmp_path / "index"))
    with open(tmp_path / "index" / "zz-part.txt", "w") as f:
        f.write("kind\tname\tcontainer\tmodifiers\tattributes\tbases\tsignature\tline\tfile\tproject\nclass\tShort\n" + "\t".join(["class", "Extra", "", "", "", "", "", "7", "f.cs", "p", "more"]) + "\r\n")
    got = read_index(spark, str(tmp_path / "index"))
    want = sorted(tuple(r) for r in decl.select(*got.columns).collect()) + [("class", "Extra", "", "", "", "", "", 7, "f.cs", "p")]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    m = store.manifest(str(tree))
    m.select(F.concat_ws("\t", "sha", "path")).write.text(str(tmp_path / "manifest"))
    back = read_manifest(spark, str(tmp_path / "manifest"))
    assert same_manifest(m, back) and same_manifest(m, m.filter("path not like '%.md'"), sources_only=True) and not same_manifest(m, m.filter("path not like '%.md'"))
    assert with_shas(m, m.filter("path like '%.md'")).count() == 1 and with_shas(m, m.limit(0)).count() == 0


def test_plain_directory(spark, tree):
    found = lambda *a, **k: sorted((r.path, r.line) for r in scan_directory(spark, str(tree), *a, **k).collect())
    assert found("Save", "*.txt") == [("docs/a/note.txt", 1), ("docs/a/note.txt", 3)]
    assert found("Save", "*.*", depth=1) == [("App/Svc.cs", 1), ("App/Svc.cs", 2), ("docs/only.md", 1)]
    assert found("", "*.txt") == []


def test_running_ids_go_on(spark):
    sizes = spark.createDataFrame([(f"{k * 7919 % 4096:03x}{k:05d}", 2, k) for k in range(500)], "sha string, n_lines int, n_bytes long")
    got = sorted(map(tuple, corpus.corpus_ids(sizes, last_id=10, last_offset=1000).select("sha", "id", "end_offset").collect()))
    offset = 1000
    for k, (r, (sha, at, end)) in enumerate(zip(sorted(map(tuple, sizes.collect())), got, strict=True)):
        offset += r[2]
        assert (sha, at, end) == (r[0], 11 + k, offset)


def test_line_reader(spark):
    cases = {"": 0, "a": 1, "a\n": 1, "a\r\nb": 2, "a\rb\r": 2, "\n\n": 2, "a\n\rb": 3}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.n for r in df.select("t", runtime_lines(F.col("t")).alias("n")).collect()} == cases
