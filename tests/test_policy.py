"""Decisions about tool events, on a small checkout."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import events, intent
from lodestone.operators.shell import Unreadable, commands, extensions, searches
from lodestone.plans.cases import BASH, OTHER, POWERSHELL, ROOT, TREE

@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame(TREE, "path string, n_lines int")


def decisions(spark, tree, payloads, **more):
    df = spark.createDataFrame(list(enumerate(payloads)), "event_id long, payload string")
    got = events.decide(df, tree, ROOT, **more).collect()
    assert sorted(r.event_id for r in got) == list(range(len(payloads)))
    return {r.event_id: r for r in got}


def test_decisions(spark, tree):
    cases = [("Bash", {"command": c}, d) for c, d in BASH] + [("PowerShell", {"command": c}, d) for c, d in POWERSHELL] + OTHER
    got = decisions(spark, tree, [json.dumps({"hook_event_name": "PreToolUse", "tool_name": t, "tool_input": i, "cwd": ROOT}) for t, i, _ in cases])
    wrong = [(case, got[k].decision) for k, case in enumerate(cases) if got[k].decision != case[2]]
    assert not wrong, "\n".join(map(str, wrong))
    for r in got.values():
        out = json.loads(r.output)
        assert out == {} if r.decision == "allow" else out["hookSpecificOutput"] == {"hookEventName": "PreToolUse", "permissionDecision": "deny", "permissionDecisionReason": r.reason}
    reasons = {case[2]: got[k].reason for k, case in enumerate(cases)}
    assert "find(decl" in reasons["declaration"] and "usages(lines" in reasons["usage"] and "preview" in reasons["read"]


def test_scope(spark, tree):
    grep = {"tool_name": "Grep", "tool_input": {"pattern": "class Member", "type": "cs"}}
    payloads = [grep, grep | {"cwd": "/other/place"}, grep | {"cwd": "/WORK/code/Applications/"}, grep | {"cwd": "/work/codex"}, grep | {"cwd": "/extra/deep"}, grep | {"cwd": 5}, {"tool_name": "Grep"}, [1], {}]
    got = decisions(spark, tree, [json.dumps(p) for p in payloads] + ["not json", None], more_roots=("/extra",))
    assert [got[k].decision for k in range(11)] == ["declaration", "allow", "declaration", "allow", "allow", "declaration", "allow", "allow", "allow", "allow", "allow"]


def test_patterns(spark):
    cases = [
        (r"class\s+Order", "name:Order:class"), (r":\s*ServiceBase", "base:ServiceBase:class"), (r"\[Obsolete", "attribute:Obsolete:"), (r"public\s+void\s+Save\s*\(", "name:Save:method,ctor"), ("std::vector", None), ("(?:foo)", None),
        ("interface ", "kind::interface"), ("Total", None), ("a.*b", None), ("partial class Foo", "name:Foo:class"), (r"enum\b", "kind::enum"), (r"x\.y", None), (r"\bclass (Order)", "name:Order:class"), (": (IThing|IOther)", "base:IOther:class"),
        ("what? : Base", "name", ), ("my.class Foo", None), ("class record", "kind::class"), ("subclass Foo", None), (r"\[ (Owner", "attribute:Owner:"), ("static Run", None), (r"Run\(", None), ("9class Foo", None), (r"override .* Run \(", "name:Run:method,ctor"), ("", None),
    ]
    cases = [(c[0], None) if c[1] == "name" else c for c in cases]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, p string").withColumn("c", intent.classify(F.col("p")))
    got = {r.i: r.s for r in df.select("i", F.when(F.col("c").isNotNull(), F.concat_ws(":", "c.by", "c.value", "c.kind")).alias("s")).collect()}
    assert [(c[0], got[i]) for i, c in enumerate(cases)] == cases


def test_words():
    assert [c.words for c in commands("a 'b c' \"d \\\"e\" f\\ g; h$(i \"j)\" k)l | m >n o 2>&1 p<q")] == [["a", "b c", 'd "e', "f g"], ["h$(i \"j)\" k)l"], ["m", "o", "p"]]
    assert [(c.name, c.args, c.piped, c.xargs) for c in commands("x=1 &&\nGIT grep a|xargs -0 {} GREP b\n\n(c)")] == [("x=1", [], False, False), ("git grep", ["a"], False, False), ("grep", ["b"], True, True), ("c", [], False, False)]
    for bad in ("'", '"', "a\\", "$(", "$('", 'x "$(y'):
        with pytest.raises(Unreadable):
            commands(bad)
    assert commands("a\\b c`\nd", windows=True)[0].words == ["a\\b", "cd"]
    assert extensions("**/*.{cs,Ts}") == {"cs", "ts"} and extensions("*.json,*.yml") == {"json", "yml"} and extensions("Makefile") == set() and extensions("a.b/c") == set()
    assert searches("") == [] and searches("   \n") == []


def test_edit_marks(spark):
    rows = [(1, '{"tool_input": {"file_path": "a.cs"}}'), (2, '{"tool_input": {"notebook_path": "b.ipynb"}}'), (3, '{"tool_input": {}}'), (4, "x")]
    assert sorted(map(tuple, events.edit_marks(spark.createDataFrame(rows, "event_id long, payload string")).collect())) == [(1, "a.cs"), (2, "b.ipynb")]
