import os
import subprocess
import time

import pytest

from lodestone.sources.worktree import decode_bytes, find_root, worktree_files
from lodestone.streaming.refresh import Conflict, Store, refresh_on_events


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.com", *args], check=True, capture_output=True)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "App.csproj").write_text("<Project/>")
    (root / "A.cs").write_text("class A { int Total; }\n")
    (root / "B.cs").write_text("#if PAF\nclass B { }\n#endif\n")
    git(root, "init", "-q")
    git(root, "add", ".")
    git(root, "commit", "-qm", "one")
    return root


def test_refresh_cycle(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    first = store.refresh(str(tree))
    assert (first.files, first.parsed, first.read) == (3, 2, 3)
    rows = {(r.name, r.file, r.project) for r in store.declarations(str(tree)).collect()}
    assert rows == {("A", "A.cs", "App"), ("Total", "A.cs", "App"), ("B", "B.cs", "App")}
    assert store.refresh(str(tree)).reused
    (tree / "A.cs").write_text("class A2 { }\n")
    store.mark_edit(str(tree))
    second = store.refresh(str(tree))
    assert not second.reused and second.read == 1 and second.parsed == 1
    assert {r.name for r in store.declarations(str(tree)).collect()} == {"A2", "B"}
    (tree / "C.cs").write_text("#if TEF\nclass C { }\n#endif\n")
    third = store.refresh(str(tree), force=True)
    assert third.invalidated
    assert {r.name for r in store.declarations(str(tree)).collect()} == {"A2", "B", "C"}
    (tree / "x.bin").write_bytes(b"a\0b")
    (tree / "B.cs").unlink()
    fourth = store.refresh(str(tree), force=True)
    assert fourth.read == 1 and fourth.parsed == 0
    assert {r.name for r in store.declarations(str(tree)).collect()} == {"A2", "C"}
    assert store.refresh(str(tree), force=True).read == 0
    assert store.prune() == 2  # the first A.cs, and B.cs
    assert not store.fresh(str(tree), time.time() + 120)


def test_what_a_dead_run_leaves(spark, tree, tmp_path, monkeypatch):
    """A run that dies at any of its writes changes nothing; the next one comes to the rows of a run that never died."""
    whole = Store(spark, str(tmp_path / "whole"))
    whole.refresh(str(tree))
    rows = lambda store: {n: sorted(map(str, store.table(n).collect())) for n in ("blob", "corpus", "sources", "decl_blob")}
    want = rows(whole)
    assert all(want.values())
    for at in range(1, 7):
        store, calls = Store(spark, str(tmp_path / f"store{at}")), []

        def dies(df, name, real=store._write, at=at, calls=calls):
            calls.append(name)
            if len(calls) == at:
                raise KeyboardInterrupt(name)
            return real(df, name)

        monkeypatch.setattr(store, "_write", dies)
        with pytest.raises(KeyboardInterrupt):
            store.refresh(str(tree))
        assert not any(rows(store).values()) and not store.state().manifests
        monkeypatch.undo()
        assert store.refresh(str(tree)).read == 3 and rows(store) == want
        assert store.vacuum() > 0 and rows(store) == want
    store = Store(spark, str(tmp_path / "late"))
    store.files.create(f"{store.folder}/commits/1.claim")
    monkeypatch.setattr("lodestone.streaming.refresh.time.sleep", lambda s: None)
    with pytest.raises(Conflict):
        store.refresh(str(tree))  # another writer is at it
    store.files.delete(f"{store.folder}/commits/1.claim")
    assert store.refresh(str(tree)).read == 3 and rows(store) == want


def test_second_writer_starts_again(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    stale = store.state()
    store.refresh(str(tree))
    with pytest.raises(Conflict):
        store.commit(stale)
    assert store.state().number == 1


def test_other_worktree_shares_contents(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.refresh(str(tree))
    other = tmp_path / "other"
    git(tree, "worktree", "add", "-q", str(other))
    (other / "App.csproj").rename(other / "Else.csproj")
    (other / "N.cs").write_text("class N { }")
    report = store.refresh(str(other))
    assert (report.read, report.parsed) == (1, 1)
    assert {(r.name, r.project) for r in store.declarations(str(other)).collect()} == {("A", "Else"), ("Total", "Else"), ("B", "Else"), ("N", "Else")}
    assert {r.project for r in store.declarations(str(tree)).collect()} == {"App"}
    assert store.fresh(str(other))  # .git is a file there
    store.forget(str(other))
    assert store.prune() == 1 and store.declarations(str(tree)).count() == 3


def test_other_files_leave_the_sources(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.refresh(str(tree))
    before = store.state()
    (tree / "notes.txt").write_text("x")
    report = store.refresh(str(tree), force=True)
    assert report.manifest_changed and not report.source_changed and report.parsed == 0
    assert store.state().tables["decl_blob"] == before.tables["decl_blob"]
    report = store.refresh(str(tree), force=True)
    assert not report.manifest_changed and store.state().manifests == {str(tree): next(iter(store.state().manifests.values()))}
    (tree / "A.cs").write_text("class A { void M( { }")
    assert store.refresh(str(tree), refresh=False).reused  # serves what there is
    report = store.refresh(str(tree), force=True)
    assert report.source_changed and report.errors and report.errors[0].startswith("A.cs:1: ")


def test_later_marks_stay(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.refresh(str(tree))
    store.mark_edit(str(tree), time.time() + 100)
    store.mark_edit(str(tree), time.time() - 100)
    assert not store.fresh(str(tree))
    store.refresh(str(tree))
    assert len(store.files.names(store._marks(str(tree)))) == 1 and not store.fresh(str(tree))
    marks = spark.createDataFrame([(str(tree / "A.cs"),), ("/elsewhere/x",)], "path string")
    other = Store(spark, str(tmp_path / "second"))
    other.mark_edits(marks, [str(tree), "/nowhere"])
    assert len(other.files.names(other._marks(str(tree)))) == 1 and not other.files.names(other._marks("/nowhere"))


def test_stream_of_edits(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    source = tmp_path / "events"
    source.mkdir()
    (source / "1.json").write_text('{"worktree": "%s", "at": 1}\n' % tree)
    stream = spark.readStream.schema("worktree string, at long").json(str(source))
    refresh_on_events(stream, store, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert store.declarations(str(tree)).count() == 3
    (tree / "A.cs").write_text("class Changed { }")
    (source / "2.json").write_text('{"worktree": "%s", "at": 2}\n' % tree)
    refresh_on_events(stream, store, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert {r.name for r in store.declarations(str(tree)).collect()} == {"Changed", "B"}


def test_git_ids_and_states(tree):
    before = dict(worktree_files(str(tree)))
    (tree / "N.txt").write_text("new")
    (tree / "A.cs").unlink()
    after = dict(worktree_files(str(tree)))
    assert set(after) == (set(before) - {"A.cs"}) | {"N.txt"} and after["B.cs"] == before["B.cs"]


def test_decoding():
    assert decode_bytes("é".encode()) == decode_bytes(b"\xef\xbb\xbf" + "é".encode()) == decode_bytes("é".encode("cp1252")) == decode_bytes(b"\xff\xfe" + "é".encode("utf-16-le")) == "é"


def test_root(tmp_path):
    for m in ("Applications", "Components"):
        (tmp_path / m / "x").mkdir(parents=True)
    assert find_root(str(tmp_path / "Components" / "x")) == str(tmp_path)
    assert find_root("/", explicit="/there") == "/there"
    assert os.path.isdir(str(tmp_path))
