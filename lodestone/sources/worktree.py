"""Files as tables: git worktrees, directories, and table rows as virtual files."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.paths import not_excluded
from ..functions.text import MAX_TEXT_BYTES, all_lines, excerpt, is_text

MANIFEST = "path string, sha string"


def _git(root: str, *args: str, data: bytes | None = None) -> bytes:
    return subprocess.run(["git", "--no-optional-locks", "-C", root, *args], input=data, capture_output=True, check=True).stdout


def worktree_files(root: str) -> list[tuple[str, str]]:
    """(path, sha) as the working tree has them, by path: the index, without what is deleted, with new ids for what is changed or untracked.
    A change that is only staged keeps the id of the index."""
    files: dict[str, str] = {}
    for entry in _git(root, "ls-files", "-s", "-z").decode("utf-8", "surrogateescape").split("\0"):
        if entry:
            meta, path = entry.split("\t", 1)
            files[path] = meta.split(" ")[1]
    dirty = []
    for entry in _git(root, "status", "--porcelain", "-z", "--no-renames", "--untracked-files=all").decode("utf-8", "surrogateescape").split("\0"):
        if entry:
            state, path = entry[:2], entry[3:]
            if "D" in state:
                files.pop(path, None)
            elif state == "??" or state[1] in "MAT":
                dirty.append(path)
    if dirty:
        ids = _git(root, "hash-object", "--stdin-paths", data="\n".join(dirty).encode("utf-8", "surrogateescape") + b"\n").decode().split()
        files.update(zip(dirty, ids, strict=True))
    return sorted(files.items())


def index_signature(root: str) -> str:
    """Time and size of git's index; follows the file that stands for .git in a secondary worktree."""
    git = os.path.join(root, ".git")
    if os.path.isfile(git):
        with open(git, encoding="utf-8") as f:
            git = os.path.join(root, f.read().partition("gitdir:")[2].strip())
    try:
        s = os.stat(os.path.join(git, "index"))
    except OSError:
        return ""
    return f"{s.st_mtime_ns}:{s.st_size}"


def decode_bytes(data: bytes | None) -> str | None:
    """By its mark, else strict UTF-8, else Windows-1252."""
    if data is None:
        return None
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in data)


#: Windows-1252 where it differs from Latin-1.
_LATIN = "".join(chr(c) for c in range(0x80, 0xA0) if bytes([c]).decode("cp1252", "ignore"))
_WINDOWS = "".join(bytes([c]).decode("cp1252", "ignore") for c in range(0x80, 0xA0))


def decoded(data: Column) -> Column:
    """Text of a binary column; null for what isn't text. By its mark, else UTF-8 if it is valid, else Windows-1252; Python sees UTF-16 alone."""
    utf16 = F.substring(data, 1, 2).isin(F.unhex(F.lit("FFFE")), F.unhex(F.lit("FEFF")))
    utf8 = data.cast("string")
    wide = F.udf(decode_bytes, StringType(), useArrow=True)(F.when(utf16, data))
    text = (
        F.when(F.substring(data, 1, 3) == F.unhex(F.lit("EFBBBF")), F.make_valid_utf8(F.substring(data, 4, MAX_TEXT_BYTES).cast("string"))).when(utf16, wide)
        .when(F.is_valid_utf8(utf8), utf8).otherwise(F.translate(F.decode(data, "ISO-8859-1"), _LATIN, _WINDOWS))
    )
    return F.when(is_text(data), text)


def directory(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path (relative), content of every file under a directory that any reader of Spark can open."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select(F.regexp_replace(F.col("path"), r"^.*?\Q" + root.rstrip("/") + r"\E/", "").alias("path"), "content")


def scan_directory(spark: SparkSession, root: str, symbol: str, glob: str = "*", depth: int | None = None) -> DataFrame:
    """path, line, text: usages in a directory that is no checkout, read as it is. The word border is the regular expression's, over letters, digits and
    underscores of any script. depth: levels of directories below the root that are looked into."""
    files = directory(spark, root, glob).filter(not_excluded(F.col("path")))
    if depth is not None:
        files = files.filter(F.size(F.split("path", "/")) <= depth + 1)
    lines = files.select("path", F.posexplode(all_lines(decoded(F.col("content")))).alias("line", "text"))
    quoted = "\\Q" + symbol.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    found = F.contains("text", F.lit(symbol)) & F.col("text").rlike(rf"(?U)(?<![\w]){quoted}(?![\w])") if symbol else F.lit(False)
    return lines.filter(found).select("path", (F.col("line") + 1).alias("line"), excerpt(F.col("text")).alias("text"))


def find_root(start: str, markers: tuple[str, ...] = ("Applications", "Components"), explicit: str | None = None, variable: str = "CODE_ROOT") -> str | None:
    """The given root, else the nearest directory above that holds all markers, else what the environment names."""
    if explicit:
        return explicit
    at = os.path.abspath(start)
    while True:
        if all(os.path.isdir(os.path.join(at, m)) for m in markers):
            return at
        up = os.path.dirname(at)
        if up == at:
            return os.environ.get(variable) or None
        at = up


def virtual_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: path source/lang/id.txt (src1 as bin, src2 as Obj, which searches leave out), text."""
    top = F.when(F.col("source") == "src1", "bin").when(F.col("source") == "src2", "Obj").otherwise(F.col("source"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.concat_ws("/", top, "lang", F.format_string("%08d.txt", "doc_id")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
