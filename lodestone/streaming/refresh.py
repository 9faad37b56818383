"""Incremental, content-addressed maintenance of the tables of one or more worktrees.

Tables: blob (sha, n_lines, is_text), corpus (sha, n_lines, line, text), sources (sha of C# contents), decl_blob (declarations by sha) and a manifest (path, sha)
for each worktree. A table is a list of segments, folders of Parquet files that never change. A commit is one file that names the segments of all tables, the symbols,
and the stamps of the worktrees; it is written aside and renamed, so a run that dies leaves what the last commit says, and segments that no commit names are
nothing but rubbish. Writers of the same time are told apart by a claim on the number of the next commit: the one that comes too late starts again from the new state.
Content is read and parsed once, whatever its number of paths and worktrees, by the executors that read it. All files go through Hadoop's file systems; worktrees
themselves must be mounted where the executors run.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..csharp import PARSER_VERSION, SCHEMA, errors, extract
from ..functions.text import directive_symbols
from ..operators.corpus import blob_lines, blob_sizes, project_of
from ..shipping import ship
from ..sources.shared import Files
from ..sources.worktree import decode_bytes, index_signature, worktree_files

WINDOW_S, MAX_BYTES, TRIES, KEEP = 60, 1_048_576, 5, 2
#: Contents that one task reads.
READ_ROWS = 2048
SCHEMAS = {"blob": "sha string, n_lines long, is_text boolean", "corpus": "sha string, n_lines int, line int, text string", "sources": "sha string", "decl_blob": SCHEMA}
PATHS = "path string, sha string"


class Conflict(RuntimeError):
    """Another writer committed first."""


@dataclass
class Report:
    """What a refresh did: files of the worktree, contents read and parsed, whether nothing was needed, whether all was parsed anew, whether the manifest or
    the C# files in it changed, seconds, and syntax errors (path:line: message) of what was parsed, in order."""

    files: int = 0
    read: int = 0
    parsed: int = 0
    reused: bool = False
    invalidated: bool = False
    manifest_changed: bool = False
    source_changed: bool = False
    seconds: float = 0.0
    errors: list[str] = field(default_factory=list)


@dataclass
class State:
    number: int = 0
    version: int = PARSER_VERSION
    symbols: list[str] = field(default_factory=list)
    tables: dict[str, list[str]] = field(default_factory=dict)
    manifests: dict[str, str] = field(default_factory=dict)
    stamps: dict[str, dict] = field(default_factory=dict)

    def segments(self) -> set[str]:
        return {s for t in self.tables.values() for s in t} | set(self.manifests.values())


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.files = Files(spark, self.folder)

    # -- commits
    def _commits(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names(f"{self.folder}/commits") if n.endswith(".json") and not n.startswith("."))

    def state(self) -> State:
        found = self._commits()
        return State(**json.loads(self.files.read(f"{self.folder}/commits/{found[-1]}.json"))) if found else State()

    def commit(self, state: State) -> State:
        """state came from the commit before; its successor is claimed, written aside and renamed."""
        number = state.number + 1
        top = f"{self.folder}/commits"
        claim = f"{top}/{number}.claim"
        if not self.files.create(claim):
            raise Conflict(claim)
        if self._commits()[-1:] > [state.number]:
            self.files.delete(claim)
            raise Conflict(f"{number}")
        state.number = number
        aside = f"{top}/.{number}-{uuid.uuid4().hex}.json"
        self.files.create(aside, json.dumps(asdict(state)))
        if not self.files.rename(aside, f"{top}/{number}.json"):
            raise Conflict(aside)
        self.files.delete(claim)
        return state

    def _again(self, change, stale_s: float = 600.0):
        """Runs a change from the newest state until its commit holds. A claim that its writer left behind is removed when it is old."""
        for k in range(TRIES):
            try:
                return change(self.state())
            except Conflict:
                claim = f"{self.folder}/commits/{self.state().number + 1}.claim"
                if self.files.exists(claim) and self.files.age(claim) > stale_s:
                    self.files.delete(claim)
                time.sleep(0.2 * (k + 1))
        raise Conflict(f"no commit in {TRIES} tries")

    # -- tables
    def _write(self, df: DataFrame, name: str) -> str:
        """A new segment."""
        segment = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/data/{segment}")
        return segment

    def _read(self, segments: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/data/{s}" for s in segments]) if segments else self.spark.createDataFrame([], schema)

    def table(self, name: str, state: State | None = None) -> DataFrame:
        return self._read((state or self.state()).tables.get(name, []), SCHEMAS[name])

    def blob(self) -> DataFrame:
        return self.table("blob")

    def corpus(self) -> DataFrame:
        return self.table("corpus")

    def decl_blob(self) -> DataFrame:
        return self.table("decl_blob")

    def manifest(self, worktree: str, state: State | None = None) -> DataFrame:
        """path, sha."""
        segment = (state or self.state()).manifests.get(os.path.abspath(worktree))
        return self._read([segment] if segment else [], PATHS)

    def lines(self, worktree: str) -> tuple[DataFrame, DataFrame]:
        """(lines, manifest) for usages and ranking."""
        state = self.state()
        return self.table("corpus", state), self.manifest(worktree, state)

    def declarations(self, worktree: str) -> DataFrame:
        """Declarations of a worktree with file and project; a view over its manifest."""
        state = self.state()
        m = self.manifest(worktree, state)
        cs = m.filter(F.lower("path").endswith(".cs"))
        projects = project_of(cs.select("path"), m.filter(F.lower("path").endswith(".csproj")).select("path"))
        return cs.join(projects, "path").join(self.table("decl_blob", state), "sha").withColumnRenamed("path", "file")

    # -- freshness
    def _marks(self, root: str) -> str:
        return f"{self.folder}/edits/{uuid.uuid5(uuid.NAMESPACE_URL, root).hex}"

    def mark_edit(self, worktree: str, at: float | None = None) -> None:
        """An edit of now, or of a time. Marks are files of their own: writers don't meet."""
        when = int((at if at is not None else time.time()) * 1000)
        self.files.create(f"{self._marks(os.path.abspath(worktree))}/{when:016d}-{uuid.uuid4().hex}")

    def mark_edits(self, marks: DataFrame, worktrees: list[str]) -> None:
        """marks: path (of an edited file). Marks each of the worktrees that holds one."""
        for root in {os.path.abspath(w) for w in worktrees}:
            if not marks.filter(F.col("path").startswith(root + "/")).isEmpty():
                self.mark_edit(root)

    def fresh(self, worktree: str, now: float | None = None) -> bool:
        """Within the window, nothing marked as edited, git's index as it was."""
        root = os.path.abspath(worktree)
        stamp = self.state().stamps.get(root)
        if not stamp or self.files.names(self._marks(root)):
            return False
        return 0 <= (now or time.time()) - stamp["started"] <= WINDOW_S and stamp["index"] == index_signature(root)

    # -- refresh
    def _contents(self, missing: DataFrame, root: str) -> DataFrame:
        """missing: sha, path. sha, text (null: not text, or gone), is_cs; read where the task runs."""
        ship(self.spark)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(0, b.num_rows, 64):
                    part = b.slice(k, 64)
                    texts = []
                    for path in part.column("path").to_pylist():
                        try:
                            with open(os.path.join(root, path), "rb") as f:
                                data = f.read(MAX_BYTES + 1)
                        except OSError:
                            data = None
                        text = None if data is None or len(data) > MAX_BYTES or b"\0" in data and data[:2] not in (b"\xff\xfe", b"\xfe\xff") else decode_bytes(data)
                        texts.append(text)
                    is_cs = [p.lower().endswith(".cs") for p in part.column("path").to_pylist()]
                    yield pa.record_batch([part.column("sha"), part.column("path"), pa.array(texts, pa.string()), pa.array(is_cs, pa.bool_())], ["sha", "path", "text", "is_cs"])

        return missing.select("sha", "path").mapInArrow(run, "sha string, path string, text string, is_cs boolean")

    def refresh(self, worktree: str, force: bool = False, refresh: bool = True) -> Report:
        """refresh=False serves what there is, however old, if there is something."""
        root, began = os.path.abspath(worktree), time.time()
        stamp = self.state().stamps.get(root)
        if stamp and (not refresh or not force and self.fresh(root)):
            return Report(files=stamp["files"], reused=True)
        report = self._again(lambda state: self._refresh(state, root))
        report.seconds = time.time() - began
        return report

    def _refresh(self, state: State, root: str) -> Report:
        started, index = time.time(), index_signature(root)
        listed = worktree_files(root)
        now = self.spark.createDataFrame(listed, PATHS)
        old = self.manifest(root, state)
        changed = now.exceptAll(old).union(old.exceptAll(now)).select(F.lower("path").endswith(".cs").alias("cs")).distinct().collect() if root in state.manifests else None
        report = Report(files=len(listed), manifest_changed=changed is None or bool(changed), source_changed=changed is None or any(r.cs for r in changed))
        missing = now.groupBy("sha").agg(F.min("path").alias("path")).join(self.table("blob", state), "sha", "left_anti")
        n = missing.count()
        report.read = n
        sources = None
        if n:
            texts = self._read([self._write(self._contents(missing.repartition(max(1, -(-n // READ_ROWS))), root), "texts")], "sha string, path string, text string, is_cs boolean")
            known = texts.filter("text is not null")
            sizes = blob_sizes(known).select("sha", "n_lines")
            blob = texts.select("sha", F.col("text").isNotNull().alias("is_text")).join(sizes, "sha", "left").select("sha", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), "is_text")
            sources = known.filter("is_cs")
            for name, df in (("corpus", blob_lines(known).select("sha", "n_lines", "line", "text")), ("blob", blob), ("sources", sources.select("sha"))):
                state.tables.setdefault(name, []).append(self._write(df, name))
        found = [r.s for r in sources.select(F.explode(directive_symbols(F.col("text"))).alias("s")).distinct().collect()] if sources is not None else []
        symbols = sorted({*state.symbols, *found})
        if (symbols != state.symbols or state.version != PARSER_VERSION) and state.tables.get("decl_blob"):
            # all is parsed anew with more symbols defined; texts come from the corpus, blank lines and all
            report.invalidated = True
            every = self.table("corpus", state).join(self.table("sources", state).distinct(), "sha").groupBy("sha").agg(F.max("n_lines").alias("n"), F.map_from_entries(F.collect_list(F.struct("line", "text"))).alias("at"))
            texts = every.select("sha", F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.coalesce(F.try_element_at("at", i), F.lit(""))), "\n").alias("text"))
            report.parsed = texts.count()
            state.tables["decl_blob"] = [self._write(extract(texts, symbols), "decl_blob")]
        elif sources is not None:
            report.parsed = sources.count()
            if report.parsed:
                state.tables.setdefault("decl_blob", []).append(self._write(extract(sources, symbols), "decl_blob"))
        if sources is not None and report.parsed:
            wrong = errors(sources, symbols).join(sources.select("sha", "path"), "sha")
            report.errors = [r.e for r in wrong.select(F.format_string("%s:%d: %s", "path", "line", "message").alias("e")).orderBy("e").limit(200).collect()]
        state.version, state.symbols = PARSER_VERSION, symbols
        if report.manifest_changed:
            state.manifests[root] = self._write(now, "manifest")
        state.stamps[root] = {"started": started, "index": index, "files": len(listed)}
        self.commit(state)
        for mark in self.files.names(self._marks(root)):
            if int(mark.split("-")[0]) <= started * 1000:  # later ones stay
                self.files.delete(f"{self._marks(root)}/{mark}")
        return report

    def prune(self) -> int:
        """Drops the content that no manifest names; the number of contents that went. Each table becomes one segment, and segments that the last commits don't
        name are deleted."""

        def change(state: State) -> int:
            gone = 0
            if state.manifests:
                live = self._read(list(state.manifests.values()), PATHS).select("sha").distinct()
                gone = self.table("blob", state).join(live, "sha", "left_anti").count()
                for name in [n for n, s in state.tables.items() if s and (gone or len(s) > 1)]:
                    state.tables[name] = [self._write(self.table(name, state).join(live, "sha", "left_semi"), name)]
                self.commit(state)
            return gone

        gone = self._again(change)
        self.vacuum()
        return gone

    def vacuum(self) -> int:
        """Deletes the segments that none of the last KEEP commits names; the number of them. Not to run beside a refresh."""
        recent = [State(**json.loads(self.files.read(f"{self.folder}/commits/{n}.json"))) for n in self._commits()[-KEEP:]]
        named = {s for state in recent for s in state.segments()}
        rubbish = [s for s in self.files.names(f"{self.folder}/data") if s not in named]
        for s in rubbish:
            self.files.delete(f"{self.folder}/data/{s}")
        for n in self._commits()[:-KEEP]:
            self.files.delete(f"{self.folder}/commits/{n}.json")
        return len(rubbish)

    def forget(self, worktree: str) -> None:
        """A worktree that is no more; what only it named goes with the next prune."""

        def change(state: State) -> None:
            root = os.path.abspath(worktree)
            state.manifests.pop(root, None), state.stamps.pop(root, None)
            self.commit(state)

        self._again(change)


def refresh_on_events(events: DataFrame, store: Store, checkpoint: str):
    """A stream of edit events (worktree, at): each batch that is there marks its worktrees and refreshes them once."""

    def batch(df: DataFrame, _: int) -> None:
        for r in df.groupBy("worktree").agg(F.max("at").alias("at")).collect():  # a row a worktree
            store.mark_edit(r.worktree)
            store.refresh(r.worktree)

    return events.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(batch).start()
