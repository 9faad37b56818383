"""Named queries over the test tables, each with DuckDB SQL for the same rows where SQL can express it.

documents are virtual files (sources.worktree.virtual_files); C# sources are generated from supplier, nation and region and parsed, while
the SQL states the expected declarations straight from the columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import csharp
from ..functions import text as T
from ..functions.paths import extension, not_excluded
from ..operators import closure, corpus, declarations, display, events, intent, search
from ..sources.index_files import parse_rows, rows_of, same_manifest, with_shas
from ..sources.shared import kept
from ..sources.worktree import decoded, virtual_files
from . import cases

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- manifest and corpus

FILES = "files AS (SELECT concat_ws('/', CASE source WHEN 'src1' THEN 'bin' WHEN 'src2' THEN 'Obj' ELSE source END, lang, printf('%08d.txt', doc_id)) AS path, coalesce(text, '') AS text, sha1(concat('blob ', octet_length(encode(coalesce(text, ''))), chr(0), coalesce(text, ''))) AS sha FROM documents)"
BLOBS = "blobs AS (SELECT sha, min(path) AS path, any_value(text) AS text FROM files GROUP BY sha)"
LINES = "parts AS (SELECT sha, string_split(CASE WHEN text LIKE '%' || chr(10) THEN substr(text, 1, length(text) - 1) ELSE text END, chr(10)) AS p, text FROM blobs), alllines AS (SELECT sha, CASE WHEN text = '' THEN 0 ELSE len(p) END AS n_lines, generate_subscripts(p, 1) AS line, regexp_replace(unnest(p), chr(13) || '$', '') AS text FROM parts), lines AS (SELECT * FROM alllines WHERE text <> '')"
BASE = f"WITH {FILES}, {BLOBS}, {LINES}"
WORD = "[A-Za-z0-9_\\x{80}-\\x{10FFFF}]"
KEPT = "NOT list_has_any(list_slice(string_split(lower(path), '/'), 1, -2), ['node_modules','bin','obj','dist','.git','packages','.vs','.vscode','publish'])"


def _word_sql(symbol: str, column: str = "l.text") -> str:
    return f"regexp_matches({column}, '(^|{WORD.replace('[', '[^')}){symbol}($|{WORD.replace('[', '[^')})')"


def _excerpt_sql(c: str = "l.text") -> str:
    t = f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN length({t}) <= 200 THEN {t} ELSE substr({t}, 1, 200) || '…' END"


def _files(spark: SparkSession, d: str) -> DataFrame:
    return virtual_files(spark, d)


# The stored corpus: built when a query first needs it, scanned by all others until the table changes.


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, "manifest", [f"{d}/documents.parquet"], lambda: corpus.manifest(_files(spark, d)))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, "blobs", [f"{d}/documents.parquet"], lambda: corpus.blobs(_files(spark, d)))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, "lines", [f"{d}/documents.parquet"], lambda: corpus.blob_lines(_texts(spark, d)))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, "sizes", [f"{d}/documents.parquet"], lambda: corpus.blob_sizes(_texts(spark, d)))


@query(f"WITH {FILES} SELECT path, sha FROM files")
def blob_sha_manifest(spark, d):
    return _manifest(spark, d)


@query(f"WITH {FILES}, {BLOBS} SELECT sha, path FROM blobs")
def distinct_blobs_first_path(spark, d):
    return _texts(spark, d).select("sha", "path")


@query(f"{BASE} SELECT sha, line, text FROM lines")
def corpus_lines(spark, d):
    return _lines(spark, d).select("sha", "line", "text")


@query(f"{BASE} SELECT count(*) AS n, CAST(sum(line) AS BIGINT) AS sum_line, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes FROM lines")
def corpus_lines_stats(spark, d):
    return _lines(spark, d).agg(F.count("*").alias("n"), F.sum("line").alias("sum_line"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes"))


SIZES = "sizes AS (SELECT sha, CAST(max(n_lines) AS BIGINT) AS n_lines, count(*) FILTER (WHERE text <> '') AS n_text_lines, CAST(coalesce(sum(octet_length(encode(text))), 0) AS BIGINT) AS n_bytes FROM alllines GROUP BY sha)"


@query(f"{BASE}, {SIZES} SELECT * FROM sizes")
def blob_line_counts(spark, d):
    return _sizes(spark, d)


@query(f"{BASE}, {SIZES} SELECT sha, row_number() OVER (ORDER BY sha) AS id, CAST(sum(n_bytes) OVER (ORDER BY sha) AS BIGINT) AS end_offset, n_lines FROM sizes")
def corpus_ids_offsets(spark, d):
    return corpus.corpus_ids(_sizes(spark, d))


@query(f"{BASE}, {SIZES}, live AS (SELECT DISTINCT sha FROM files WHERE path NOT LIKE 'src3/%'), k AS (SELECT sizes.* FROM sizes JOIN live USING (sha)) SELECT sha, row_number() OVER (ORDER BY sha) AS id, CAST(sum(n_bytes) OVER (ORDER BY sha) AS BIGINT) AS end_offset, n_lines FROM k")
def prune_renumber(spark, d):
    live = _manifest(spark, d).filter("path not like 'src3/%'").select("sha")
    return corpus.corpus_ids(_sizes(spark, d), live)


@query(f"WITH {FILES} SELECT path, octet_length(encode(text)) <= 1048576 AND NOT contains(text, chr(0)) AS is_text, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM files")
def text_gate(spark, d):
    data = F.col("text").cast("binary")
    return _files(spark, d).select("path", T.is_text(data).alias("is_text"), F.octet_length(data).cast("long").alias("n_bytes"))


@query(f"WITH {FILES} SELECT path, text FROM files")
def decode_sources(spark, d):
    """Texts by turns as UTF-8, with its mark, as UTF-16 either way round, and as Latin-1 where they have no other characters."""
    text, turn = F.col("text"), F.crc32(F.col("path").cast("binary")) % 5
    marked = lambda mark, charset: F.concat(F.unhex(F.lit(mark)), F.encode(text, charset))
    data = (
        F.when(turn == 0, text.cast("binary")).when(turn == 1, marked("EFBBBF", "UTF-8")).when((turn == 2) & (F.char_length(text) < 200_000), marked("FFFE", "UTF-16LE")).when((turn == 3) & (F.char_length(text) < 200_000), marked("FEFF", "UTF-16BE"))
        .when((turn == 4) & text.rlike(r"^[\x00-\x7F\xA0-\xFF]*$"), F.encode(text, "ISO-8859-1")).otherwise(text.cast("binary"))
    )
    return _files(spark, d).select("path", decoded(data).alias("text"))


@query(f"WITH {FILES}, old AS (SELECT path, sha FROM files WHERE hash_id % 7 <> 0), new AS (SELECT path, CASE WHEN hash_id % 5 = 0 THEN sha1(sha) ELSE sha END AS sha FROM files WHERE hash_id % 11 <> 0) SELECT path, CASE WHEN o.sha IS NULL THEN 'added' WHEN n.sha IS NULL THEN 'removed' WHEN o.sha <> n.sha THEN 'changed' ELSE 'same' END AS change FROM old o FULL JOIN new n USING (path)".replace("hash_id", "CAST(regexp_extract(path, '(\\d+)\\.txt$', 1) AS BIGINT)"))
def manifest_diff(spark, d):
    m = _manifest(spark, d)
    n = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long")
    new = m.filter(n % 11 != 0).select("path", F.when(n % 5 == 0, F.sha1("sha")).otherwise(F.col("sha")).alias("sha"))
    return corpus.manifest_changes(m.filter(n % 7 != 0), new)


@query(f"WITH {FILES}, m AS (SELECT path, sha, CAST(regexp_extract(path, '(\\d+)\\.txt$', 1) AS BIGINT) AS k FROM files) SELECT path, CASE WHEN k % 5 = 0 THEN sha1(sha) ELSE sha END AS sha FROM m WHERE k % 10 <> 0")
def overlay_dirty(spark, d):
    m = _manifest(spark, d)
    n = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long")
    return corpus.overlay(m, m.filter(n % 5 == 0).select("path", F.when(n % 10 != 0, F.sha1("sha")).alias("sha")))


@query(f"WITH {FILES}, known AS (SELECT DISTINCT sha FROM files WHERE path LIKE '%/en/%') SELECT DISTINCT sha FROM files WHERE sha NOT IN (SELECT sha FROM known)")
def missing_blobs(spark, d):
    m = _manifest(spark, d)
    return m.select("sha").distinct().join(m.filter("path like '%/en/%'").select("sha"), "sha", "left_anti")


@query(f"WITH {FILES}, old AS (SELECT path, CASE WHEN path LIKE '%1.txt' THEN '' ELSE sha END AS sha FROM files) SELECT f.path, f.sha FROM files f JOIN old USING (path, sha)")
def seed_reuse(spark, d):
    m = _manifest(spark, d)
    old = m.select("path", F.when(F.col("path").endswith("1.txt"), "").otherwise(F.col("sha")).alias("sha"))
    return m.join(old, ["path", "sha"], "left_semi")


@query(f"WITH {FILES} SELECT path, regexp_extract(regexp_extract(path, '[^/]*$'), '^.+?(\\.[^.]*)$', 1) AS ext, {KEPT} AS kept FROM files")
def path_filters(spark, d):
    return _files(spark, d).select("path", extension(F.col("path")).alias("ext"), not_excluded(F.col("path")).alias("kept"))


@query(f"WITH {FILES}, t AS (SELECT path, replace(replace(replace(text, 'er', chr(13)), 'on', chr(13) || chr(10)), 'xx', '') AS t FROM files), c AS (SELECT *, len(regexp_extract_all(t, '\\r\\n|\\r|\\n')) AS n FROM t) SELECT path, CAST(CASE WHEN t = '' THEN 0 WHEN regexp_matches(t, '[\\r\\n]$') THEN n ELSE n + 1 END AS INTEGER) AS n_lines FROM c")
def line_reader_counts(spark, d):
    """Lines as a line reader counts them, over texts with all three kinds of line end."""
    text = F.replace(F.replace(F.col("text"), F.lit("er"), F.lit("\r")), F.lit("on"), F.lit("\r\n"))
    return _files(spark, d).select("path", T.runtime_lines(F.replace(text, F.lit("xx"), F.lit(""))).alias("n_lines"))


@query(f"WITH {FILES}, m AS (SELECT sha, path FROM files), o AS (SELECT CASE WHEN path LIKE '%7.txt' THEN sha1(sha) ELSE sha END AS sha, path FROM m) SELECT (SELECT count(*) = 0 FROM (SELECT * FROM m EXCEPT SELECT * FROM m)) AS same, (SELECT count(*) = 0 FROM (SELECT * FROM m EXCEPT SELECT * FROM o)) AS same_changed, TRUE AS same_sources")
def manifest_equality(spark, d):
    m = _manifest(spark, d)
    other = m.withColumn("sha", F.when(F.col("path").endswith("7.txt"), F.sha1("sha")).otherwise(F.col("sha")))
    return spark.createDataFrame([(same_manifest(m, m), same_manifest(m, other), same_manifest(m, other, sources_only=True))], "same boolean, same_changed boolean, same_sources boolean")


@query(f"WITH {FILES}, k AS (SELECT DISTINCT sha FROM files WHERE path LIKE 'src4/%') SELECT path, sha FROM files JOIN k USING (sha)")
def manifest_by_shas(spark, d):
    m = _manifest(spark, d)
    return with_shas(m, m.filter("path like 'src4/%'")).select("path", "sha")


HEAD = f"{BASE} SELECT f.path, l.line, l.text FROM alllines l JOIN files f USING (sha) WHERE l.n_lines > 0 AND (l.line <= 3 OR l.line > l.n_lines - 2)"


@query(HEAD)
def summarize_head_tail(spark, d):
    """Positions count blank lines, and blank lines are shown."""
    return corpus.preview(_manifest(spark, d), _sizes(spark, d), _lines(spark, d), 3, 2).select("path", "line", "text")


# ---------------------------------------------------------------- usages and ranking


def _usages(name: str, symbol: str, scope: str | None = None, globs: list[str] | None = None, more: str = "") -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return search.usages(_lines(spark, d), _manifest(spark, d), symbol, scope, globs)

    run.__name__ = name
    query(f"{BASE} SELECT DISTINCT f.path, l.line, {_excerpt_sql()} AS text FROM lines l JOIN files f USING (sha) WHERE {KEPT} AND {_word_sql(symbol)}{more}")(run)


_usages("usages_all", "erthing")
_usages("usages_scoped", "the", "src5\\", None, " AND lower(f.path) LIKE 'src5/%'")
_usages("usages_include", "que", None, ["*3.txt", "src7/**/*.txt"], " AND (f.path LIKE '%3.txt' OR regexp_matches(f.path, '^src7/.*/[^/]*[.]txt$'))")
_usages("usages_include_deep", "de", None, ["*3.txt", "src7/**/es/*.txt", "src5/**/*7.txt"], " AND (f.path LIKE '%3.txt' OR (f.path LIKE 'src5/%/%7.txt'))")
_usages("usages_accented_symbol", "ción")
_usages("usages_partial_accented", "mente")
_usages("usages_numeric_symbol", "168")
_usages("usages_token", "token")


# Documents with every e as a character of two UTF-16 units: an excerpt ends before a character that would be cut in two.
ASTRAL = "t AS (SELECT doc_id, replace(replace(coalesce(text, ''), chr(10), ' '), 'e', '😀') AS text FROM documents), c AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM t), u AS (SELECT doc_id, text, generate_subscripts(p, 1) AS i, unnest(p) AS ch FROM (SELECT *, string_split(text, '') AS p FROM c)), w AS (SELECT *, sum(CASE WHEN unicode(ch) > 65535 THEN 2 ELSE 1 END) OVER (PARTITION BY doc_id, text ORDER BY i) AS units FROM u), k AS (SELECT doc_id, any_value(text) AS text, max(units) AS units, count(*) FILTER (WHERE units <= 200) AS n FROM w GROUP BY doc_id, text)"


@query(f"WITH {ASTRAL} SELECT doc_id, CASE WHEN units <= 200 THEN text ELSE substr(text, 1, n) || '…' END AS excerpt FROM k WHERE text <> ''")
def usages_excerpt(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("e"), F.lit("😀"))
    shown = docs.select("doc_id", text.alias("t")).filter(T.trimmed(F.col("t")) != "")
    return shown.groupBy("doc_id", "t").count().select("doc_id", T.excerpt(F.col("t")).alias("excerpt"))


@query(f"{BASE}, u AS (SELECT DISTINCT f.path, l.line FROM lines l JOIN files f USING (sha) WHERE {KEPT} AND {_word_sql('of')}) SELECT path, count(*) AS n FROM u GROUP BY path")
def usages_per_file_totals(spark, d):
    return search.usages(_lines(spark, d), _manifest(spark, d), "of").groupBy("path").agg(F.count("*").alias("n"))


@query(f"{BASE}, u AS (SELECT DISTINCT f.path, l.line, {_excerpt_sql()} AS text FROM lines l JOIN files f USING (sha) WHERE {KEPT} AND {_word_sql('was')}) SELECT row_number() OVER (ORDER BY path, line) AS place, path || chr(9) || line || chr(9) || text AS row FROM u")
def usages_printed(spark, d):
    """Rows as they are printed, by path and line; the order is part of the rows."""
    found = display.placed(search.usages(_lines(spark, d), _manifest(spark, d), "was"), *display.USAGES)
    return found.select("place", display.usages_row().alias("row"))


@query(f"{BASE}, u AS (SELECT DISTINCT f.path, l.line FROM lines l JOIN files f USING (sha) WHERE {KEPT} AND {_word_sql('with')}) SELECT count(*) AS n, count(DISTINCT path) AS n_files FROM u")
def usages_totals(spark, d):
    return search.usages(_lines(spark, d), _manifest(spark, d), "with").agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_files"))


@query(f"{BASE}, u AS (SELECT DISTINCT f.path, l.line FROM lines l JOIN files f USING (sha) WHERE {_word_sql('zzqqxx')}) SELECT 'zzqqxx' AS symbol, count(*) AS n FROM u")
def usages_missing(spark, d):
    return search.usages(_lines(spark, d), _manifest(spark, d), "zzqqxx").agg(F.lit("zzqqxx").alias("symbol"), F.count("*").alias("n"))


def _rank_sql(terms: list[str], top: int, more: str = "") -> str:
    k = range(len(terms))
    tf = ", ".join(f"CAST(count(*) FILTER (WHERE {_word_sql(t)}) AS DOUBLE) AS tf{i}" for i, t in enumerate(terms))
    hit = " OR ".join(_word_sql(t) for t in terms)
    df = ", ".join(f"CAST(count(*) FILTER (WHERE tf{i} > 0) AS DOUBLE) AS df{i}" for i in k)
    score = " + ".join(f"ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in k)
    names = "list_filter([" + ", ".join(f"CASE WHEN tf{i} > 0 THEN '{t}' END" for i, t in enumerate(terms)) + "], lambda x: x IS NOT NULL)"
    return (
        f"{BASE}, paths AS (SELECT path, sha FROM files f WHERE {KEPT}{more}), c AS (SELECT l.sha, CAST(max(n_lines) AS DOUBLE) AS dl, {tf}, list_sort(list(DISTINCT line) FILTER (WHERE {hit})) AS hits FROM lines l WHERE l.sha IN (SELECT sha FROM paths) GROUP BY l.sha), s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl, {df} FROM c), r AS (SELECT path, {score} AS score, array_to_string({names}, ',') AS terms, array_to_string(hits, ',') AS lines FROM c CROSS JOIN s JOIN paths USING (sha) WHERE len(hits) > 0) "
        f"SELECT path, round(score, 6) AS score, terms, lines FROM r ORDER BY r.score DESC, path LIMIT {top}"
    )


def _rank(name: str, terms: list[str], scope: str | None = None, globs: list[str] | None = None, top: int = 20, more: str = "") -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = search.rank(_lines(spark, d), _manifest(spark, d), terms, scope, globs, top)
        return found.withColumn("score", F.round("score", 6))

    run.__name__ = name
    query(_rank_sql(terms, top, more))(run)


_rank("rank_bm25", ["token", "shea", "reer"])
_rank("rank_scoped", ["para", "los"], "src4", None, 20, " AND lower(f.path) LIKE 'src4/%'")
_rank("rank_include_top", ["was", "license"], None, ["*7.txt"], 5, " AND f.path LIKE '%7.txt'")


@query(_rank_sql(["token", "was", "license"], 30).replace("SELECT path, round(score, 6) AS score, terms, lines FROM r", "SELECT row_number() OVER (ORDER BY r.score DESC, path) AS place, path || chr(9) || printf('%.2f', score) || chr(9) || terms || chr(9) || lines AS row, CAST(len(string_split(lines, ',')) AS INTEGER) AS n_lines, array_to_string(list_slice(string_split(lines, ','), 1, 8), ', ') || CASE WHEN len(string_split(lines, ',')) > 8 THEN ' (+' || (len(string_split(lines, ',')) - 8) || ')' ELSE '' END AS shown FROM r"))
def rank_printed(spark, d):
    """Rows as they are printed, best first, with the eight first lines and the number of others."""
    found = search.rank(_lines(spark, d), _manifest(spark, d), ["token", "was", "license"], top=30)
    rows = display.placed(found, F.desc("score"), "path")
    return rows.select("place", display.ranked_row().alias("row"), F.size(F.split("lines", ",")).alias("n_lines"), display.first_lines().alias("shown"))


# ---------------------------------------------------------------- C# declarations

SOURCE = """using System;
#if FEATURE_{m}
namespace Acme.Area{n}
{{
    [Serializable, Owner("x{k}")]
    public sealed class Supplier{k} : Area{n}ServiceBase, IThing{k}, IHandler<int, string>
    {{
        private readonly int low = 1, high;
        public event EventHandler Changed;
        public Supplier{k}(string name, int[] codes) : base(name) {{ Run(); }}
        [Obsolete]
        public string Name {{ get; set; }} = "a;{{b";
        public List<Dictionary<string, int>> Load<T>(ref int a, params T[] rest) where T : class => null;
        void IDisposable.Dispose() {{ if (a < b) {{ }} }}
        public int this[int i, string key] {{ get {{ return 0; }} }}
        public enum Level{k} {{ Low, High = 2 }}
        public delegate void Done(object sender);
        Func<int, string> make = x => "}}";
    }}
    internal struct Pair<TA, TB> {{ }}
    [ServiceContract]
    public interface IThing{k} : IBase {{ void SaveAction(); }}
    public record Money{k}(decimal Amount, string Code) : Value;
    readonly record struct Spot{k}(int X, int Y) : IHandler<(int, string), Dictionary<string, List<List<int>>>> {{ }}
    class Closing{k} {{ ~Closing{k}() {{ }} public static bool operator ==(Closing{k} a, Closing{k} b) => true; }}
#if !OFF
    class Hidden{k} {{ }}
#else
    class Shown{k} {{ }}
#endif
}}
#else
class Lost{k} {{ }}
#endif
"""
# What a file holds: kind, name, container, modifiers, attributes, bases, signature, line.
EXPECTED = [
    ("class", "Supplier{k}", "Acme.Area{n}", "public sealed", "Serializable,Owner", "Area{n}ServiceBase,IThing{k},IHandler<int, string>", "", 6),
    ("field", "low", "Acme.Area{n}.Supplier{k}", "private readonly", "", "", "int", 8),
    ("field", "high", "Acme.Area{n}.Supplier{k}", "private readonly", "", "", "int", 8),
    ("event", "Changed", "Acme.Area{n}.Supplier{k}", "public", "", "", "EventHandler", 9),
    ("ctor", "Supplier{k}", "Acme.Area{n}.Supplier{k}", "public", "", "", "(string,int[])", 10),
    ("property", "Name", "Acme.Area{n}.Supplier{k}", "public", "Obsolete", "", "string", 12),
    ("method", "Load", "Acme.Area{n}.Supplier{k}", "public", "", "", "List<Dictionary<string, int>> (int,T[])", 13),
    ("method", "IDisposable.Dispose", "Acme.Area{n}.Supplier{k}", "", "", "", "void ()", 14),
    ("indexer", "this", "Acme.Area{n}.Supplier{k}", "public", "", "", "int [int,string]", 15),
    ("enum", "Level{k}", "Acme.Area{n}.Supplier{k}", "public", "", "", "", 16),
    ("enummember", "Low", "Acme.Area{n}.Supplier{k}.Level{k}", "", "", "", "", 16),
    ("enummember", "High", "Acme.Area{n}.Supplier{k}.Level{k}", "", "", "", "", 16),
    ("delegate", "Done", "Acme.Area{n}.Supplier{k}", "public", "", "", "void (object)", 17),
    ("field", "make", "Acme.Area{n}.Supplier{k}", "", "", "", "Func<int, string>", 18),
    ("struct", "Pair`2", "Acme.Area{n}", "internal", "", "", "", 20),
    ("interface", "IThing{k}", "Acme.Area{n}", "public", "ServiceContract", "IBase", "", 22),
    ("method", "SaveAction", "Acme.Area{n}.IThing{k}", "", "", "", "void ()", 22),
    ("record", "Money{k}", "Acme.Area{n}", "public", "", "Value", "", 23),
    ("record", "Spot{k}", "Acme.Area{n}", "readonly", "", "IHandler<(int, string), Dictionary<string, List<List<int>>>>", "", 24),
    ("class", "Closing{k}", "Acme.Area{n}", "", "", "", "", 25),
    ("class", "Shown{k}", "Acme.Area{n}", "", "", "", "", 29),
]
AREA = "namespace Acme;\n[GeneratedCode]\npublic abstract class Area{n}ServiceBase : Region{r}ServiceCore {{ protected int state; }}\n"
EXPECTED_AREA = [("class", "Area{n}ServiceBase", "Acme", "public abstract", "GeneratedCode", "Region{r}ServiceCore", "", 3), ("field", "state", "Acme.Area{n}ServiceBase", "protected", "", "", "int", 3)]
REGION = "namespace Acme {{ public class Region{r}ServiceCore : Root {{ public void Start() {{ }} }} public class Aside{r} {{ }} }}\n"
EXPECTED_REGION = [("class", "Region{r}ServiceCore", "Acme", "public", "", "Root", "", 1), ("method", "Start", "Acme.Region{r}ServiceCore", "public", "", "", "void ()", 1), ("class", "Aside{r}", "Acme", "public", "", "", "", 1)]


def _fill(template: str, **columns) -> F.Column:
    import re as _re

    parts = _re.split(r"\{(\w)\}", template.replace("{{", "\x01").replace("}}", "\x02"))
    return F.concat(*[columns[p].cast("string") if i % 2 else F.lit(p.replace("\x01", "{").replace("\x02", "}")) for i, p in enumerate(parts)])


def sources(spark: SparkSession, d: str) -> DataFrame:
    """path, text of generated C# files and project files."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    k, n, r = F.col("s_suppkey"), F.col("s_nationkey"), F.col("n_regionkey")
    supplier = read("supplier").select(_fill("Code/Area{n}/Supplier{k}.cs", n=n, k=k).alias("path"), _fill(SOURCE, k=k, n=n, m=n % 3).alias("text"))
    nk = F.col("n_nationkey")
    area = read("nation").select(_fill("Code/Area{n}/Area{n}.designer.cs", n=nk).alias("path"), _fill(AREA, n=nk, r=r).alias("text"))
    region = read("region").select(_fill("Code/Shared/Region{r}.cs", r=F.col("r_regionkey")).alias("path"), _fill(REGION, r=F.col("r_regionkey")).alias("text"))
    projects = read("nation").filter(nk % 2 == 1).select(_fill("Code/Area{n}/Proj{n}.csproj", n=nk).alias("path"), F.lit("").alias("text"))
    return supplier.union(area).union(region).union(projects).union(spark.range(1).select(F.lit("Code/Whole.csproj"), F.lit("")))


def declared(spark: SparkSession, d: str) -> DataFrame:
    """The stored declaration table."""
    return kept(spark, f"declarations-{csharp.PARSER_VERSION}", [f"{d}/{t}.parquet" for t in ("supplier", "nation", "region")], lambda: _declared(spark, d))


def _declared(spark: SparkSession, d: str) -> DataFrame:
    """The declaration table of the generated sources: symbols first, then each content once, then a row a file."""
    files = sources(spark, d)
    cs = files.filter("path like '%.cs'").withColumn("sha", T.content_sha(F.col("text")))
    symbols = sorted(r.s for r in cs.select(F.explode(T.directive_symbols(F.col("text"))).alias("s")).distinct().collect())
    decl = csharp.extract(cs.groupBy("sha").agg(F.any_value("text").alias("text")), symbols)
    project = corpus.project_of(cs.select("path"), files.filter("path like '%.csproj'").select("path"))
    return cs.select("sha", "path").join(project, "path").join(decl, "sha").drop("sha").withColumnRenamed("path", "file")


def _expected() -> str:
    def rows(items: list[tuple]) -> str:
        return ", ".join("(" + ", ".join([str(i), *("'" + str(x).replace("'", "''") + "'" for x in row[:-1]), str(row[-1])]) + ")" for i, row in enumerate(items))

    def fill(c: str, *keys: str) -> str:
        for k in keys:
            c = f"replace({c}, '{{{k[0]}}}', CAST({k[2:]} AS VARCHAR))"
        return c

    def part(source: str, path: str, items: list[tuple], keys: tuple[str, ...], project: str) -> str:
        names = ("kind", "name", "container", "modifiers", "attributes", "bases", "signature")
        return f"SELECT {fill(repr(path), *keys)} AS file, {project} AS project, CAST(v.ord AS INTEGER) AS ord, {', '.join(f'{fill("v." + c, *keys)} AS {c}' for c in names)}, CAST(v.line AS INTEGER) AS line FROM {source} CROSS JOIN (VALUES {rows(items)}) v(ord, kind, name, container, modifiers, attributes, bases, signature, line)"

    area_project = "CASE WHEN {0} % 2 = 1 THEN 'Proj' || {0} ELSE 'Whole' END"
    return "decl AS (" + " UNION ALL ".join([
        part("supplier", "Code/Area{n}/Supplier{k}.cs", EXPECTED, ("n=s_nationkey", "k=s_suppkey"), area_project.format("s_nationkey")),
        part("nation", "Code/Area{n}/Area{n}.designer.cs", EXPECTED_AREA, ("n=n_nationkey", "r=n_regionkey"), area_project.format("n_nationkey")),
        part("region", "Code/Shared/Region{r}.cs", EXPECTED_REGION, ("r=r_regionkey",), "'Whole'"),
    ]) + ")"


DECL = f"WITH RECURSIVE {_expected()}"
COLUMNS = "file, project, ord, kind, name, container, modifiers, attributes, bases, signature, line"
VISIBLE = "NOT (regexp_matches(lower(file), '[.]designer[.]cs$') OR regexp_matches(concat_ws(chr(9), kind, name, container, modifiers, attributes, bases, signature, line, file, project), '(?i)(^|[' || chr(9) || ',.])GeneratedCode(Attribute)?([,' || chr(9) || ']|$)'))"


@query(f"{DECL} SELECT {COLUMNS} FROM decl WHERE kind IN ('class', 'interface', 'struct', 'record', 'enum', 'delegate')")
def decl_parse_types(spark, d):
    return declared(spark, d).filter(F.col("kind").isin("class", "interface", "struct", "record", "enum", "delegate")).select(*COLUMNS.split(", "))


@query(f"{DECL} SELECT {COLUMNS} FROM decl WHERE kind NOT IN ('class', 'interface', 'struct', 'record', 'enum', 'delegate')")
def decl_parse_members(spark, d):
    return declared(spark, d).filter(~F.col("kind").isin("class", "interface", "struct", "record", "enum", "delegate")).select(*COLUMNS.split(", "))


@query(f"{DECL} SELECT file, line, count(*) AS n FROM decl GROUP BY file, line")
def decl_lines(spark, d):
    return declared(spark, d).groupBy("file", "line").agg(F.count("*").alias("n"))


@query(f"{DECL} SELECT kind, name, container, modifiers, attributes, bases, signature, line, file, project FROM decl WHERE line <> 9")
def index_rows(spark, d):
    """Rows of text, some of them short or without a number, read back as declarations."""
    decl = declared(spark, d)
    good = decl.select(F.when(F.col("line") == 9, F.lit("event\tbad\t\t\t\t\t\tnine\tf\tp")).otherwise(rows_of(decl)).alias("value"))
    return parse_rows(good.union(decl.limit(50).select(F.concat_ws("\t", "kind", "name"))))


@query("SELECT DISTINCT 'FEATURE_' || (s_nationkey % 3) AS symbol FROM supplier UNION SELECT 'OFF' FROM supplier")
def preproc_symbols(spark, d):
    return sources(spark, d).select(F.explode(T.directive_symbols(F.col("text"))).alias("symbol")).distinct()


@query("WITH s AS (SELECT DISTINCT 'FEATURE_' || (s_nationkey % 3) AS symbol FROM supplier UNION SELECT 'OFF' FROM supplier UNION SELECT 'PAF') SELECT string_agg(symbol, ',' ORDER BY symbol) AS symbols FROM s")
def symbol_union(spark, d):
    found = preproc_symbols(spark, d).agg(F.array_sort(F.array_union(F.array(F.lit("PAF")), F.collect_set("symbol"))).alias("s"))
    return found.select(F.array_join("s", ",").alias("symbols"))


@query("SELECT 'Code/Area' || s_nationkey || '/Supplier' || s_suppkey || '.cs' AS file, CAST(s_nationkey % 3 = 1 AS INTEGER) AS n_supplier, CAST(s_nationkey % 3 <> 1 AS INTEGER) AS n_lost FROM supplier")
def decl_conditional(spark, d):
    cs = sources(spark, d).filter("path like '%/Supplier%.cs'").withColumn("sha", F.col("path"))
    found = csharp.extract(cs, ["FEATURE_1"]).groupBy(F.col("sha").alias("file"))
    return found.agg(F.count_if(F.col("name").startswith("Supplier") & (F.col("kind") == "class")).cast("int").alias("n_supplier"), F.count_if(F.col("name").startswith("Lost")).cast("int").alias("n_lost"))


@query("SELECT 'Code/Area0/broken' || s_suppkey || '.cs' AS file, CAST(2 AS INTEGER) AS line, TRUE AS has_class FROM supplier")
def decl_errors(spark, d):
    text = F.concat(F.lit("class A"), F.col("s_suppkey").cast("string"), F.lit(" { int x;\n void M( { }\n}\n"))
    src = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("Code/Area0/broken"), F.col("s_suppkey").cast("string"), F.lit(".cs")).alias("sha"), text.alias("text"))
    found = csharp.extract(src, []).filter("kind = 'class'").groupBy("sha").agg((F.count("*") > 0).alias("has_class"))
    return csharp.errors(src, []).join(found, "sha").select(F.col("sha").alias("file"), "line", "has_class")


@query("SELECT 'Code/Area' || s_nationkey || '/Supplier' || s_suppkey || '.cs' AS path, CASE WHEN s_nationkey % 2 = 1 THEN 'Proj' || s_nationkey ELSE 'Whole' END AS project FROM supplier")
def project_of_path(spark, d):
    files = sources(spark, d)
    return corpus.project_of(files.filter("path like '%/Supplier%.cs'").select("path"), files.filter("path like '%.csproj'").select("path"))


def _find(called: str, where: str, visible: bool = True, **filters) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return declarations.find(declared(spark, d), **filters, include_generated=not visible).select("file", "kind", "name", "container", "line")

    run.__name__ = called
    query(f"{DECL} SELECT file, kind, name, container, line FROM decl WHERE {where}" + (f" AND {VISIBLE}" if visible else ""))(run)


_find("decl_by_name", "name IN ('Supplier7', 'Supplier7`1')", name="Supplier7")
_find("decl_by_name_generic", "name = 'Pair`2'", name="Pair")
_find("decl_by_name_wildcard", "name LIKE 'Sup%er_5'", name="Sup*er?5")
_find("decl_by_container", "regexp_matches(container, '^(.*[.])?Supplier3(`\\d+)?$')", container="Supplier3")
_find("decl_by_file", "contains(file, 'Area1/')", file="Area1\\")
_find("decl_by_project", "project = 'Proj3'", project="Proj3")
_find("decl_by_kind", "kind IN ('method', 'ctor')", kind="method, ctor")
_find("decl_by_base", "regexp_matches(bases, '(^|[,.])IHandler(<|,|$)')", base="IHandler")
_find("decl_by_attribute", "regexp_matches(attributes, '(^|[,.])Owner(Attribute)?(<|,|$)')", attribute="Owner")
_find("decl_exclude_generated", "kind = 'class'", kind="class")
_find("decl_include_generated", "kind = 'class'", False, kind="class")
_find("decl_combined", "kind = 'class' AND project = 'Whole' AND regexp_matches(attributes, '(^|[,.])Serializable(Attribute)?(<|,|$)')", kind="class", project="Whole", attribute="Serializable")


@query(f"{DECL}, g AS (SELECT *, 'GeneratedCode' AS mark FROM decl) SELECT kind, name, line, regexp_matches(CASE WHEN line % 2 = 0 THEN bases || ',generatedcodeAttribute' ELSE bases || ',GeneratedCodes' END, '(?i)(^|[,.])GeneratedCode(Attribute)?(,|$)') OR regexp_matches(lower(file), '[.]designer[.]cs$') OR contains(attributes, 'GeneratedCode') AS made FROM g")
def decl_generated_mark(spark, d):
    """The mark of generated code in any column, in any case of letters."""
    marked = F.when(F.col("line") % 2 == 0, ",generatedcodeAttribute").otherwise(",GeneratedCodes")
    return declared(spark, d).withColumn("bases", F.concat("bases", marked)).select("kind", "name", "line", declarations.generated().alias("made"))


@query(f"{DECL}, b AS (SELECT CASE WHEN line % 2 = 0 THEN upper(name) ELSE name END AS name FROM decl) SELECT min(name) AS key, count(*) AS n FROM b GROUP BY lower(name)")
def decl_group_folded(spark, d):
    """Groups that differ in case alone are one."""
    named = declared(spark, d).withColumn("name", F.when(F.col("line") % 2 == 0, F.upper("name")).otherwise(F.col("name")))
    return declarations.group(named, "name", ignore_case=True)


@query(f"{DECL}, v AS (SELECT * FROM decl WHERE kind = 'class' AND {VISIBLE}), n AS (SELECT *, row_number() OVER (ORDER BY file, line, ord) AS place, count(*) OVER () AS total FROM v) SELECT place, file, line, name, CAST(greatest(total - 25, 0) AS BIGINT) AS hidden FROM n WHERE place <= 25")
def decl_capped(spark, d):
    """What is displayed of a long answer: the first rows by file and line, and how many are hidden."""
    shown = display.capped(declarations.find(declared(spark, d), kind="class"), ["file", "line", "ord"], 25)
    return shown.select("place", "file", "line", "name", "hidden")


@query(f"{DECL}, g AS (SELECT project AS key, count(*) AS n FROM decl GROUP BY project) SELECT key, n, row_number() OVER (ORDER BY n DESC, key DESC) AS place FROM g")
def decl_group_order(spark, d):
    """Groups by count, of equal counts the later key first; the order is part of the rows."""
    return display.placed(declarations.group(declared(spark, d), "project"), F.desc("n"), F.desc("key"))


def _group(by: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return declarations.group(declared(spark, d), by)

    run.__name__ = f"decl_group_{by}"
    query(f"{DECL} SELECT {by} AS key, count(*) AS n FROM decl GROUP BY {by}")(run)


for _by in declarations.GROUPS:
    _group(_by)


@query(f"{DECL} SELECT count(*) AS n, count(DISTINCT project) AS n_groups FROM decl")
def decl_totals(spark, d):
    return declarations.totals(declared(spark, d), "project")


@query(f"{DECL} SELECT file, line, CASE WHEN attributes <> '' THEN '[' || replace(replace(replace(attributes, ', ', ','), ',', ', '), '  ', ' ') || '] ' ELSE '' END || name || CASE WHEN bases <> '' THEN ' : ' || replace(replace(bases, ', ', ','), ',', ', ') ELSE '' END AS shown FROM decl WHERE kind = 'class'")
def decl_displayed(spark, d):
    return declared(spark, d).filter("kind = 'class'").select("file", "line", declarations.displayed().alias("shown"))


@query(f"{DECL} SELECT string_split(name, '`')[1] AS name, count(DISTINCT project) AS projects, count(*) AS n FROM decl WHERE kind IN ('class', 'interface', 'struct', 'record') GROUP BY 1 HAVING count(DISTINCT project) > 1")
def homonyms_by_project(spark, d):
    return declarations.homonyms(declared(spark, d))


@query("SELECT 'Level' || s_suppkey AS name, CAST(1 AS BIGINT) AS n FROM supplier UNION ALL SELECT 'Area' || n_nationkey || 'ServiceBase', CAST(1 AS BIGINT) FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT 'Aside' || r_regionkey, CAST(1 AS BIGINT) FROM region UNION ALL SELECT x || s_suppkey, CAST(1 AS BIGINT) FROM supplier, (VALUES ('Closing'), ('Shown')) v(x)")
def dead_declarations(spark, d):
    decl = declared(spark, d).filter("kind in ('enum', 'class')")
    return declarations.unused(decl, corpus.blob_lines(corpus.blobs(sources(spark, d))))


# ---------------------------------------------------------------- closure

CLOSURE = f"""{DECL}, types AS (SELECT *, CASE WHEN container = '' THEN name ELSE container || '.' || name END AS type_key, string_split(name, '`')[1] AS simple FROM decl WHERE kind IN ('class', 'interface', 'struct', 'record')),
edges AS (SELECT type_key, file, ord, kind, list_last(string_split(trim(unnest(string_split(regexp_replace(bases, '<[^<>]*>', '', 'g'), ','))), '.')) AS base FROM types WHERE bases <> ''),
contracts AS (SELECT DISTINCT simple FROM types WHERE kind = 'interface' AND contains(attributes, 'ServiceContract')),
services AS (SELECT DISTINCT type_key FROM edges WHERE kind = 'class' AND (regexp_matches(base, 'Service(Base|Core)$') OR base IN (SELECT simple FROM contracts))),
walk AS (SELECT type_key, 0 AS depth FROM types WHERE {{seeds}} UNION SELECT t.type_key, w.depth + 1 FROM walk w JOIN edges e USING (type_key) JOIN types t ON t.simple = e.base WHERE w.depth < 6 AND (w.depth = 0 OR w.type_key IN (SELECT type_key FROM services))),
loaded AS (SELECT DISTINCT type_key FROM walk)"""
SLICE = " SELECT t.file, t.name, t.type_key, CAST(t.type_key IN (SELECT type_key FROM loaded) AS INTEGER) AS loaded FROM types t WHERE lower(t.file) IN (SELECT lower(file) FROM types JOIN loaded USING (type_key))"


@query(CLOSURE.replace("{seeds}", "type_key IN (SELECT type_key FROM services) AND lower(file) LIKE 'code/area3/%'") + SLICE)
def closure_scope(spark, d):
    decl = declared(spark, d)
    return closure.close(decl, closure.scope_seeds(decl, "Code\\Area3"))[0].select("file", "name", "type_key", "loaded")


@query(CLOSURE.replace("{seeds}", "type_key IN (SELECT type_key FROM services) AND lower(file) LIKE 'code/area3/%'") + " SELECT file, line, name, container, row_number() OVER (ORDER BY file, line, ord) AS place FROM decl WHERE kind NOT IN ('class', 'interface', 'struct', 'record') AND container IN (SELECT type_key FROM loaded)")
def closure_members(spark, d):
    """Members by file and line; the order is part of the rows."""
    decl = declared(spark, d)
    members = closure.close(decl, closure.scope_seeds(decl, "Code/Area3/"))[2]
    return display.placed(members, "file", "line", "ord").select("file", "line", "name", "container", "place")


@query(CLOSURE.replace("{seeds}", "type_key IN (SELECT container FROM decl WHERE kind = 'method' AND name IN ('Start', 'StartAction'))") + SLICE)
def closure_symbol(spark, d):
    decl = declared(spark, d)
    return closure.close(decl, closure.operation_seeds(decl, "StartAction"))[0].select("file", "name", "type_key", "loaded")


@query(CLOSURE.replace("{seeds}", "lower(file) = 'code/area4/area4.designer.cs'") + SLICE)
def closure_file(spark, d):
    decl = declared(spark, d)
    return closure.close(decl, closure.file_seeds(decl, "Code\\Area4\\area4.designer.cs"))[0].select("file", "name", "type_key", "loaded")


# ---------------------------------------------------------------- policy

# Patterns by event_id modulo their number, with what they are classified as; N stands for the event's user.
PATTERNS = [
    (r"class\s+OrderN", "name:OrderN:class"), (r":\s*ServiceN", "base:ServiceN:class"), (r"\[OwnerN", "attribute:OwnerN:"), (r"public\s+void\s+SaveN\s*\(", "name:SaveN:method,ctor"),
    (r"std::vectorN", ""), (r"(?:fooN)", ""), (r"interface ", "kind::interface"), (r"TotalN", ""), (r"aN.*b", ""), (r"partial class FooN", "name:FooN:class"), (r"enum\b", "kind::enum"), (r"x\.yN", ""),
    (r": (IThing|IOtherN)", "base:IOtherN:class"), (r"what\? : BaseN", ""), (r"my.class FooN", ""), (r"subclass FooN", ""), (r"override .* RunN \(", "name:RunN:method,ctor"),
]


def _regex_sql(p: str) -> str:
    bare = f"replace({p}, chr(92) || 'b', '')"
    return f"regexp_matches({bare}, '[][.*+?(){{}}|^$' || chr(92) || chr(92) || ']')"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def _pick(values: list[str], column: str = "event_id") -> F.Column:
    """The value of the event's turn, N as its user."""
    return F.replace(F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(column) % len(values) + 1).cast("int")), F.lit("N"), F.col("user_id").cast("string"))


def _picked(values: list[str]) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"replace([{listed}][event_id % {len(values)} + 1], 'N', CAST(user_id AS VARCHAR))"


def _payload(tool: str, cwd: F.Column | None = None, **fields: F.Column) -> F.Column:
    """JSON of an event; fields that are null are left out."""
    given = F.struct(*[c.alias(n.replace("__", "-")) for n, c in fields.items()])
    at = F.lit(cases.ROOT) if cwd is None else cwd
    return F.to_json(F.struct(F.lit("PreToolUse").alias("hook_event_name"), F.lit(tool).alias("tool_name"), at.alias("cwd"), given.alias("tool_input"))).alias("payload")


def _decided(spark: SparkSession, e: DataFrame, payload: F.Column) -> DataFrame:
    tree = spark.createDataFrame(cases.TREE, "path string, n_lines int")
    return events.decide(e.select("event_id", payload), tree, cases.ROOT)


@query("SELECT event_id, event_type AS tool, 'user' || user_id AS pattern, event_id % 3 = 0 AS has_context, event_id % 4 = 1 AS folded FROM events")
def policy_payload(spark, d):
    """Fields of payloads: absent, null, false, zero and true values of options."""
    e = _events(spark, d)
    turn = F.col("event_id")
    fold = F.when(turn % 4 == 0, '"-i": null').when(turn % 4 == 1, '"-i": true').when(turn % 4 == 2, '"-i": 0').otherwise('"-i": ""')
    context = F.when(turn % 3 == 0, ', "-A": 2').when(turn % 3 == 1, ', "-A": null').otherwise("")
    raw = F.concat(F.lit('{"tool_name": "'), "event_type", F.lit('", "tool_input": {"pattern": "user'), F.col("user_id").cast("string"), F.lit('", '), fold, context, F.lit("}}"))
    return events.parsed(e.select("event_id", raw.alias("payload"))).select("event_id", "tool", events.text_of("pattern").alias("pattern"), events.present("-A").alias("has_context"), events.truthy("-i").alias("folded"))


@query("SELECT event_id, CASE WHEN event_id % 7 IN (1, 3) THEN 'allow' ELSE 'declaration' END AS decision FROM events")
def policy_scope(spark, d):
    places = ["/work/code", "/work/other", "/WORK/code/Applications/", "/work/codeN", "/work/code/x/../y", "/work/code/docs"]
    at = F.when(F.col("event_id") % 7 < 6, F.element_at(F.array(*map(F.lit, places)), (F.col("event_id") % 7 + 1).cast("int")))
    return _decided(spark, _events(spark, d), _payload("Grep", at, pattern=F.concat(F.lit("class User"), F.col("user_id").cast("string")), path=F.lit(cases.ROOT), type=F.lit("cs"))).select("event_id", "decision")


@query(f"WITH e AS (SELECT event_id, {_picked([p for p, _ in PATTERNS])} AS p, {_picked([c for _, c in PATTERNS])} AS found FROM events) SELECT event_id, found, {_regex_sql('p')} AS has_regex FROM e")
def policy_classify(spark, d):
    e = _events(spark, d).select("event_id", _pick([p for p, _ in PATTERNS]).alias("p")).withColumn("c", intent.classify(F.col("p")))
    return e.select("event_id", F.when(F.col("c").isNotNull(), F.concat_ws(":", "c.by", "c.value", "c.kind")).otherwise("").alias("found"), intent.has_regex(F.col("p")).alias("has_regex"))


GLOBS = ["**/*.cs", "Applications/AN/**/*.cs", "**/ExactN.cs", "Components/*.cs", "src/*N.txt", "web/b/c*N.cs", "web/**/*.cs", "docs/N/*.md"]


@query(f"WITH g AS (SELECT event_id, {_picked(GLOBS)} AS g FROM events), s AS (SELECT *, contains(regexp_extract(g, '[^/]*$'), '*') AND g LIKE '%.cs' AS broad, regexp_replace(regexp_replace(g, '[^/]*[*].*$', ''), '/$', '') AS start FROM g) SELECT event_id, CASE WHEN broad AND start IN ('', 'Applications', 'Components') THEN 'listing' ELSE 'allow' END AS decision FROM s")
def policy_glob(spark, d):
    return _decided(spark, _events(spark, d), _payload("Glob", pattern=_pick(GLOBS))).select("event_id", "decision")


FILES_READ = [p for p, _ in cases.TREE]


@query(f"WITH f AS (SELECT event_id, event_id % 5 = 0 AS part, {_picked(FILES_READ)} AS path FROM events), t AS (SELECT * FROM (VALUES {', '.join(str(x) for x in cases.TREE)}) v(path, n)) SELECT event_id, CASE WHEN NOT part AND ((path LIKE '%.cs' AND n >= 2000) OR (regexp_matches(path, '[.](js|ts|tsx|jsx|sql|py)$') AND n >= 500)) THEN 'read' ELSE 'allow' END AS decision FROM f LEFT JOIN t USING (path)")
def policy_read_size(spark, d):
    limit = F.when(F.col("event_id") % 5 == 0, 10)
    return _decided(spark, _events(spark, d), _payload("Read", file_path=F.concat(F.lit("/work/code/"), _pick(FILES_READ)), limit=limit)).select("event_id", "decision")


GREP_PATHS = ["Applications", "docs", "Applications/X/Foo.cs", "Applications/Y.Controller", "scripts/run", "missingN", "web", "Applications/X/*.cs", "/elsewhere/N"]


@query(f"WITH e AS (SELECT event_id, {_picked([p for p, _ in PATTERNS])} AS p, {_picked([c for _, c in PATTERNS])} AS c, event_id % {len(GREP_PATHS)} AS place, user_id % 3 = 0 AS folded FROM events) SELECT event_id, CASE WHEN place IN (1, 2, 4, 6, 8) THEN 'allow' WHEN c <> '' THEN 'declaration' WHEN folded OR {_regex_sql('p')} THEN 'allow' ELSE 'usage' END AS decision FROM e")
def policy_grep(spark, d):
    return _decided(spark, _events(spark, d), _payload("Grep", pattern=_pick([p for p, _ in PATTERNS]), path=_pick(GREP_PATHS), __i=F.col("user_id") % 3 == 0)).select("event_id", "decision")


SHELL = [(c.replace("Member", "MemberN"), w) for c, w in cases.BASH if "NOWHERE" not in c]
POWERSHELL = [(c.replace("Member", "MemberN"), w) for c, w in cases.POWERSHELL]


@query(f"SELECT event_id, {_picked([w for _, w in SHELL])} AS decision FROM events")
def policy_shell(spark, d):
    return _decided(spark, _events(spark, d), _payload("Bash", command=_pick([c for c, _ in SHELL]))).select("event_id", "decision")


@query(f"SELECT event_id, {_picked([w for _, w in POWERSHELL])} AS decision FROM events")
def policy_powershell(spark, d):
    return _decided(spark, _events(spark, d), _payload("PowerShell", command=_pick([c for c, _ in POWERSHELL]))).select("event_id", "decision")


@query("SELECT event_id, 'src' || (user_id % 7) || '/f' || event_id || CASE WHEN event_id % 4 = 1 THEN '.ipynb' ELSE '.cs' END AS path FROM events WHERE event_id % 4 IN (0, 1)")
def policy_edit_marks(spark, d):
    """Paths of edit events: file_path, else notebook_path; others mark nothing."""
    e = _events(spark, d)
    name = F.concat(F.lit("src"), (F.col("user_id") % 7).cast("string"), F.lit("/f"), F.col("event_id").cast("string"))
    turn = F.col("event_id") % 4
    payload = _payload("Edit", file_path=F.when(turn == 0, F.concat(name, F.lit(".cs"))), notebook_path=F.when(turn <= 1, F.concat(name, F.lit(".ipynb"))))
    return events.edit_marks(e.select("event_id", payload))


@query("SELECT event_id, CASE WHEN event_id % 3 = 1 THEN '' ELSE '{\"hookSpecificOutput\":{\"hookEventName\":\"SessionStart\",\"additionalContext\":\"Ask /store first.\\n\\nno git\\n\"}}' END AS output FROM events")
def policy_session_start(spark, d):
    at = F.when(F.col("event_id") % 3 == 0, cases.ROOT + "/Components").when(F.col("event_id") % 3 == 1, "/work/else")
    e = _events(spark, d).select("event_id", F.to_json(F.struct(F.lit("SessionStart").alias("hook_event_name"), at.alias("cwd"))).alias("payload"))
    return events.session_blocks(e, "Ask {{STORE}} first.\n", {"STORE": "/store"}, ["no git"], [cases.ROOT])


DENIED = '{"hookSpecificOutput":{"hookEventName":"PreToolUse","permissionDecision":"deny","permissionDecisionReason":"Grep \'@\' needs no regular expression: use usages(lines, manifest, \'@\') or find(decl, name=\'@\')"}}'.replace("'", "''")


@query(f"SELECT event_id, CASE WHEN event_type = 'click' THEN replace('{DENIED}', '@', 'user' || user_id) ELSE '{{}}' END AS output FROM events")
def policy_json(spark, d):
    pattern = F.concat(F.when(F.col("event_type") == "click", "user").otherwise("^user"), F.col("user_id").cast("string"))
    return _decided(spark, _events(spark, d), _payload("Grep", pattern=pattern, glob=F.lit("*.cs"))).select("event_id", "output")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
