"""Decisions about tool events: allow, or deny with a better query.

An event is a JSON payload (hook_event_name, tool_name, tool_input, cwd). Fields are read from it as variants, so presence, null and truth of a value
can be told. Rules are columns; only shell lines need a parser (Python, on Arrow batches). Facts about files come from a table of the
checkout's files (path, n_lines), joined by folder. Whatever can't be read is allowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bind
from ..functions.paths import ancestors, extension
from ..shipping import ship
from ..sources.shared import staged
from . import intent
from .shell import Unreadable, searches

# What the rules know.
CODE = (".cs", ".js", ".ts", ".tsx", ".jsx", ".sql", ".py")
CS_LINES, OTHER_LINES = 2000, 500
BROAD_ROOTS = ("applications", "components")
SKIPPED = ("bin", "obj", "node_modules", ".git", ".vs", "packages", "dist", "publish")
LEVELS, ENTRIES = 4, 3000
SEARCHED = "event_id long, cwd string, ord int, kind string, tool string, pattern string, paths array<string>, recursive boolean, raw boolean, source boolean, base string"


# ---------------------------------------------------------------- payload


def parsed(events: DataFrame) -> DataFrame:
    """events: event_id, payload. event_id, event, tool, cwd, input (a variant; null if there is none)."""
    v = F.try_parse_json("payload")
    out = events.select("event_id", v.alias("v"))
    text = lambda name: F.when(F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant")) == "STRING", F.try_variant_get("v", f"$.{name}", "string"))
    given = F.try_variant_get("v", "$.tool_input", "variant")
    return out.select("event_id", F.coalesce(text("hook_event_name"), F.lit("")).alias("event"), F.coalesce(text("tool_name"), F.lit("")).alias("tool"), text("cwd").alias("cwd"), F.when(F.schema_of_variant(given).startswith("OBJECT"), given).alias("input"))


def _field(name: str) -> Column:
    return F.try_variant_get("input", f'$["{name}"]', "variant")


def _kind(name: str) -> Column:
    return F.coalesce(F.schema_of_variant(_field(name)), F.lit("VOID"))


def text_of(name: str) -> Column:
    """A field that is text, else null."""
    return F.when(_kind(name) == "STRING", F.try_variant_get("input", f'$["{name}"]', "string"))


def present(name: str) -> Column:
    """There and not null."""
    return _kind(name) != "VOID"


def truthy(name: str) -> Column:
    """Present, and neither false, zero nor the empty text."""
    kind = _kind(name)
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get("input", f'$["{name}"]', "boolean")).when(kind == "STRING", text_of(name) != "").when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), True)
        .when(kind == "VOID", False).otherwise(F.try_variant_get("input", f'$["{name}"]', "double") != 0)
    )


# ---------------------------------------------------------------- places


def rooted(path: Column) -> Column:
    return path.rlike(r"^(?:[/\\]|[A-Za-z]:)")


def resolved(path: Column, base: Column | None = None, home: str = "/~") -> Column:
    """A path with slashes: /e/x is E:/x, ~ the home folder, relative ones are below the base; without . and .. parts."""
    home_or_drive = lambda p: (
        F.when(p.rlike("^/[A-Za-z](?:/|$)"), F.concat(F.upper(F.substring(p, 2, 1)), F.lit(":/"), F.substring(p, 4, 1 << 30))).when(p.rlike("^~(?:/|$)"), F.concat(F.lit(home), F.substring(p, 2, 1 << 30))).otherwise(p)
    )
    below = lambda p: p if base is None else F.when(~rooted(p) & base.isNotNull(), F.concat_ws("/", base, p)).otherwise(p)
    fold = lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))

    def clean(p: Column) -> Column:
        parts = F.filter(F.split(p, r"[/\\]"), lambda x: (x != "") & (x != "."))
        return F.concat(F.when(p.rlike(r"^[/\\]"), "/").otherwise(""), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), fold), "/"))

    slashed = F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/")
    return bind(bind(bind(slashed, home_or_drive), below), clean)


def relative(path: Column, root: str) -> Column:
    """Path below the root ('' for the root itself), in any case of letters; null outside. A path that isn't rooted counts from the root."""
    top = root.rstrip("/").lower()
    return bind(path, lambda p: F.when(~rooted(p), p).when(F.lower(p) == top, "").when(F.lower(p).startswith(top + "/"), F.substring(p, len(top) + 2, 1 << 30)))


def in_scope(cwd: Column, roots: list[str]) -> Column:
    """In or below one of the roots; without a folder, yes."""
    tops = [r.replace("\\", "/").rstrip("/").lower() for r in roots]
    inside = lambda at: reduce(lambda a, b: a | b, [(at == t) | at.startswith(t + "/") for t in tops])
    return cwd.isNull() | bind(F.lower(resolved(cwd)), inside)


def broad_glob(pattern: Column) -> Column:
    """A wildcard in the file name of a glob for C# files."""
    name = F.element_at(F.split(pattern, r"[/\\]"), -1)
    return name.endswith(".cs") & F.contains(name, F.lit("*"))


def fixed_prefix(pattern: Column) -> Column:
    """Directories before the first part with a wildcard."""
    wild = lambda parts: F.coalesce(F.array_position(F.transform(parts, lambda p: F.translate(p, "*?[", "") != p), True), F.lit(0)).cast("int")
    return bind(F.split(pattern, r"[/\\]"), lambda parts: F.array_join(F.when(wild(parts) > 0, F.slice(parts, 1, wild(parts) - 1)).otherwise(parts), "/"))


def bounded(start: Column, base: Column, root: str, home: str = "/~") -> Column:
    """Does a listing start below the directories that hold everything, or outside of the checkout? What a variable names can't be told."""
    below = lambda parts: (F.size(parts) > 1) | (F.size(parts) == 1) & ~F.lower(F.get(parts, F.lit(0))).isin(*BROAD_ROOTS)
    inside = bind(relative(resolved(start, base, home), root), lambda at: at.isNull() | bind(F.filter(F.split(at, "/"), lambda p: p != ""), below))
    return F.when(start == "", False).when(F.contains(start, F.lit("$")), True).otherwise(inside)


# ---------------------------------------------------------------- what folders hold


def folders(tree: DataFrame) -> DataFrame:
    """tree: path (of files). folder (in lower case, '' for the root), has_cs: a C# file within LEVELS levels, or too many entries to tell."""
    low = tree.select(F.lower("path").alias("path"))
    up = low.select("path", F.explode(ancestors(F.col("path"))).alias("folder"))
    rest = F.filter(F.split(F.when(F.col("folder") == "", F.col("path")).otherwise(F.expr("substring(path, length(folder) + 2)")), "/"), lambda x: x != "")
    near = up.withColumn("rest", rest).filter((F.size("rest") <= LEVELS + 1) & ~F.arrays_overlap(F.slice("rest", 1, F.size("rest") - 1), F.array(*map(F.lit, SKIPPED))))
    every = up.select("folder").distinct()
    counted = near.groupBy("folder").agg(F.max(F.col("path").endswith(".cs")).alias("cs"), F.count("*").alias("n"))
    return every.join(counted, "folder", "left").select("folder", F.coalesce(F.col("cs") | (F.col("n") > ENTRIES), F.lit(False)).alias("has_cs"))


def code_targets(probes: DataFrame, tree: DataFrame) -> DataFrame:
    """probes: event_id, ord, path (relative to the root, '' for it), recursive. event_id, ord, is_cs (any path holds C#), is_file (all paths are named files).
    A folder counts by what it holds, a file by its extension, a wildcard by the folder before it or, in the name alone of a search that doesn't recurse, by the
    files that it names; what doesn't exist is taken for code."""
    known = folders(tree)
    files = tree.select(F.lower("path").alias("low")).distinct()
    at = F.lower(F.trim(F.col("path"), F.lit("/")))
    wild = F.translate(F.col("path"), "*?", "") != F.col("path")
    name = F.element_at(F.split("low", "/"), -1)
    p = probes.withColumn("low", at).withColumn("wild", wild).withColumn("direct", F.col("wild") & ~F.col("recursive") & F.get(F.split("low", "/"), F.size(F.split("low", "/")) - 1).rlike(r"[*?]") & ~F.regexp_replace("low", "[^/]*$", "").rlike(r"[*?]"))
    p = p.withColumn("folder", F.when(F.col("wild"), F.lower(fixed_prefix(F.col("low")))).otherwise(F.col("low")))
    named = p.join(known, "folder", "left").join(files.withColumn("exists", F.lit(True)), "low", "left")
    # a wildcard in the name: C# files of the folder that fit it
    cs = files.filter(F.col("low").endswith(".cs")).select(F.regexp_replace("low", "/?[^/]*$", "").alias("folder"), name.alias("file"))
    fits = F.rlike("file", F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"([.+^$(){}|\[\]\\])", r"\\$1"), r"\*", ".*"), r"\?", "."), F.lit("$")))
    direct = p.filter("direct").join(cs, "folder").filter(fits).select("event_id", "ord", "low").distinct().withColumn("fits", F.lit(True))
    ext = extension(F.col("low"))
    is_cs = (
        F.when(F.col("direct") & (ext == ""), F.coalesce("fits", F.lit(False))).when(F.col("wild") & (ext == ""), F.coalesce("has_cs", F.lit(True))).when(~F.col("wild") & F.col("has_cs").isNotNull(), F.col("has_cs"))
        .when((ext != "") | F.coalesce("exists", F.lit(False)), ext == ".cs").otherwise(True)
    )
    is_file = ~F.col("wild") & F.col("has_cs").isNull() & (ext != "")
    return named.join(direct, ["event_id", "ord", "low"], "left").groupBy("event_id", "ord").agg(F.max(is_cs).alias("is_cs"), F.min(is_file).alias("is_file"))


# ---------------------------------------------------------------- decisions


def shell_searches(events: DataFrame) -> DataFrame:
    """events: event_id, cwd, command, windows. A row a search or listing, in the order in which they are judged."""
    ship(events.sparkSession)

    def one(command: str | None, windows: bool | None) -> list:
        try:
            return searches(command or "", bool(windows))
        except Unreadable:
            return []
        except Exception:  # noqa: BLE001  a rule that breaks must not stop anybody's work
            return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"kind": pa.string(), "tool": pa.string(), "pattern": pa.string(), "paths": pa.list_(pa.string()), "recursive": pa.bool_(), "raw": pa.bool_(), "source": pa.bool_(), "base": pa.string()}
        for b in batches:
            rows = [(i, k, s) for i, (c, w) in enumerate(zip(b.column("command").to_pylist(), b.column("windows").to_pylist(), strict=True)) for k, s in enumerate(one(c, w))]
            at = pa.array([r[0] for r in rows], pa.int64())
            columns = [b.column("event_id").take(at), b.column("cwd").take(at), pa.array([r[1] for r in rows], pa.int32())]
            columns += [pa.array([getattr(r[2], n) for r in rows], t) for n, t in types.items()]
            yield pa.record_batch(columns, ["event_id", "cwd", "ord", *types])

    # lines are short and parsing isn't: few input files shall not mean few tasks
    return events.select("event_id", "cwd", "command", "windows").repartition("event_id").mapInArrow(run, SEARCHED)


def grep_filter() -> Column:
    """Does the type or the glob of a content search take C# files? Null without either."""
    kind, glob = F.lower(F.coalesce(text_of("type"), F.lit(""))), F.coalesce(text_of("glob"), F.lit(""))
    named = glob.rlike(r"(?i)\.cs(?:,|$)|\.\{(?:[^{}]*,)?cs(?:,[^{}]*)?\}")
    return F.when(kind != "", kind.isin("cs", "csharp")).when(glob != "", ~glob.startswith("!") & named)


def decide(events: DataFrame, tree: DataFrame, root: str, more_roots: tuple[str, ...] = (), home: str = "/~") -> DataFrame:
    """events: event_id, payload. tree: path, n_lines of the checkout at root. event_id, decision (allow, declaration, usage, listing or read), reason and
    output (JSON, {} if allowed) of every event."""
    e = parsed(events).withColumn("scoped", in_scope(F.col("cwd"), [root, *more_roots]))
    live = e.filter("scoped")
    none = F.lit(None).cast("string")

    pattern = F.coalesce(text_of("pattern"), F.lit(""))
    globs = live.filter("tool = 'Glob'").withColumn("pattern", pattern).filter(broad_glob(F.col("pattern")))
    globs = globs.filter(~bounded(F.coalesce(text_of("path"), fixed_prefix(F.col("pattern"))), F.col("cwd"), root, home))
    denied = globs.select("event_id", F.lit(0).alias("ord"), F.lit("listing").alias("decision"), F.col("tool").alias("label"), "pattern", none.alias("by"), none.alias("value"), none.alias("kind"))

    path = F.coalesce(text_of("path"), F.lit(""))
    raw = present("-A") | present("-B") | present("-C") | present("context") | truthy("-i") | truthy("multiline")
    greps = live.filter("tool = 'Grep'").select("event_id", F.lit(0).alias("ord"), F.lit("search").alias("kind"), F.lit("Grep").alias("tool"), pattern.alias("pattern"), F.array(path).alias("paths"), F.lit(True).alias("recursive"), raw.alias("raw"), grep_filter().alias("source"), "cwd")
    lines = live.filter("tool in ('Bash', 'PowerShell')").select("event_id", "cwd", text_of("command").alias("command"), (F.col("tool") == "PowerShell").alias("windows"))
    shells = shell_searches(lines).withColumn("cwd", F.when(F.col("base").isNotNull(), resolved(F.col("base"), F.col("cwd"), home)).otherwise(F.col("cwd"))).drop("base")
    every = staged(greps.unionByName(shells.select(*greps.columns)), "searches")  # lines are parsed once

    listed = every.filter("kind = 'listing'").filter(broad_glob(F.col("pattern"))).filter(~bounded(F.get("paths", F.lit(0)), F.col("cwd"), root, home))
    denied = denied.union(listed.select("event_id", "ord", F.lit("listing"), "tool", "pattern", none, none, none))

    found = every.filter("kind = 'search' and pattern <> ''")
    probes = found.select("event_id", "ord", "recursive", "cwd", F.explode(F.when(F.size("paths") > 0, F.col("paths")).otherwise(F.array(F.lit("")))).alias("given"))
    probes = probes.select("event_id", "ord", "recursive", "given", relative(resolved(F.col("given"), F.col("cwd"), home), root).alias("path")).filter("path is not null")
    targets = code_targets(probes, tree)
    looks = intent.classify(F.col("pattern"))
    judged = found.join(targets, ["event_id", "ord"]).filter(F.coalesce("source", "is_cs") & ~(F.col("is_file") & (F.size("paths") > 0))).withColumn("looks", looks)
    kind = F.when(F.col("looks").isNotNull(), "declaration").when(~(F.col("raw") | intent.has_regex(F.col("pattern"))), "usage")
    searched = judged.withColumn("decision", kind).filter("decision is not null")
    denied = denied.union(searched.select("event_id", "ord", "decision", "tool", "pattern", "looks.by", "looks.value", "looks.kind"))

    at = F.lower(relative(resolved(text_of("file_path"), None, home), root))
    reads = live.filter("tool = 'Read'").filter(~present("limit")).withColumn("low", at).join(tree.select(F.lower("path").alias("low"), "n_lines").groupBy("low").agg(F.max("n_lines").alias("n_lines")), "low")
    ext = extension(F.col("low"))
    most = F.when(ext == ".cs", CS_LINES).when(ext.isin(*CODE), OTHER_LINES)
    long = reads.filter(F.col("n_lines") >= most)
    denied = denied.union(long.select("event_id", F.lit(0), F.lit("read"), F.col("tool"), text_of("file_path"), ext, F.col("n_lines").cast("string"), none))

    # searches come before listings in ord; the first denial of an event counts
    first = denied.groupBy("event_id").agg(F.min(F.struct("ord", "decision", "label", "pattern", "by", "value", "kind")).alias("d"))
    out = e.select("event_id").join(first, "event_id", "left").select("event_id", F.coalesce("d.decision", F.lit("allow")).alias("decision"), reason("d").alias("reason"))
    return out.withColumn("output", output(F.col("decision") != "allow", F.col("reason")))


def reason(d: str) -> Column:
    """Why an event is denied, with the call to make instead."""
    c = lambda n: F.coalesce(F.col(f"{d}.{n}"), F.lit(""))
    by = F.when(c("by") == "kind", F.format_string("find(decl, kind='%s', file='<folder>/')", c("kind"))).when(c("by") == "attribute", F.format_string("find(decl, attribute='%s')", c("value")))
    call = by.when(c("by") == "base", F.format_string("find(decl, base='%s', kind='class')", c("value"))).otherwise(F.format_string("find(decl, name='%s', kind='%s')", c("value"), c("kind")))
    usage = F.format_string("usages(lines, manifest, '%s')", c("pattern"))
    return (
        F.when(c("decision") == "declaration", F.format_string("%s '%s' looks for a declaration: use %s", c("label"), c("pattern"), call))
        .when(c("decision") == "usage", F.format_string("%s '%s' needs no regular expression: use %s%s", c("label"), c("pattern"), usage, F.when(intent.is_name(c("pattern")), F.format_string(" or find(decl, name='%s')", c("pattern"))).otherwise("")))
        .when(c("decision") == "listing", F.format_string("%s '%s' lists C# files everywhere: name a folder, or use usages and find(decl, file=...)", c("label"), c("pattern")))
        .when(c("decision") == "read", F.format_string("%s has %s lines: use preview(lines, head, tail)%s, then read a part", c("pattern"), c("value"), F.when(c("by") == ".cs", " and find(decl, file=...)").otherwise("")))
        .otherwise("")
    )


def output(denied: Column, why: Column) -> Column:
    """{} if allowed."""
    return F.when(denied, F.to_json(F.struct(F.struct(F.lit("PreToolUse").alias("hookEventName"), F.lit("deny").alias("permissionDecision"), why.alias("permissionDecisionReason")).alias("hookSpecificOutput")))).otherwise("{}")


def edit_marks(events: DataFrame) -> DataFrame:
    """event_id and path of what an event edits: file_path, else notebook_path."""
    path = F.coalesce(text_of("file_path"), text_of("notebook_path"))
    return parsed(events).select("event_id", path.alias("path")).filter("path is not null and path <> ''")


def session_blocks(events: DataFrame, template: str, values: dict[str, str], notes: list[str], roots: list[str]) -> DataFrame:
    """event_id, output: what a session in scope is told when it starts, as JSON; '' out of scope. template: a text with {{NAME}} for each of the values; notes (what is
    missing on this machine) follow it."""
    block = template
    for name, value in values.items():
        block = block.replace("{{" + name + "}}", value)
    if notes:
        block = block.rstrip() + "\n\n" + "\n".join(notes) + "\n"
    told = F.to_json(F.struct(F.struct(F.lit("SessionStart").alias("hookEventName"), F.lit(block).alias("additionalContext")).alias("hookSpecificOutput")))
    return parsed(events).select("event_id", F.when(in_scope(F.col("cwd"), roots), told).otherwise("").alias("output"))
