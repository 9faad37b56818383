"""Cases of tool events with the decision that each gets, on a small checkout."""

ROOT = "/work/code"
TREE = [
    ("Applications/X/Foo.cs", 2100), ("Applications/X/Sub/Bar.cs", 10), ("Applications/X/tool.py", 900), ("Applications/X/note.md", 9000), ("Applications/Y.Controller/Z.cs", 1999),
    ("Components/Lib/Lib.cs", 5), ("docs/readme.md", 3), ("docs/deep/a/b/c/d/Late.cs", 4), ("scripts/run", 7), ("web/index.ts", 499), ("web/bin/Made.cs", 2),
]
BASH = [
    ("grep -rn 'class Member' .", "declaration"), ("rg 'class\\s+Member'", "declaration"), ("rg -t cs ':\\s*ServiceBase'", "declaration"), ("git grep 'interface IThing'", "declaration"),
    ("grep -rn Member Applications/", "usage"), ("rg Member Applications/X", "usage"), ("rg -i Member", "allow"), ("grep -rni Member Applications", "allow"), ("grep -rn -A 3 Member Applications", "allow"),
    ("rg 'Mem.*Save'", "allow"), ("grep Member Applications/X/Foo.cs", "allow"), ("grep 'class Foo' Applications/X/Foo.cs", "allow"), ("grep Member Applications/X/*.cs", "usage"),
    ("grep -rn --include='*.ts' Member .", "allow"), ("grep -rn --include='*.{ts,cs}' Member .", "usage"), ("grep -rn --exclude=*.cs Member .", "allow"), ("rg -g '!*.cs' Member", "allow"), ("rg -tpy Member", "allow"),
    ("cat x.txt | grep Member", "allow"), ("rtk grep -rn Member Applications", "usage"), ("rtk proxy rg Member", "usage"), ("grep -rn Member Applications 2>/dev/null | head -5", "usage"),
    ("rg Member Applications 2>/dev/null; echo done", "usage"), ("find . -name '*.cs'", "listing"), ("find . -name 'Foo.cs'", "allow"), ("find Applications/X -name '*.cs'", "allow"), ("find Applications -name '*Tests.cs'", "listing"),
    ("find . -name '*.cs' | xargs grep Member", "usage"), ("find . -name '*.cs' | xargs grep 'a.*b'", "allow"), ("find docs -name '*.md' | xargs grep Member", "allow"), ("make && ls", "allow"), ("grep -rn 'open", "allow"),
    ("F=Applications/X/Foo.cs; grep Member $F", "allow"), ("D=Applications; grep -rn Member $D", "usage"), ("D=$(pwd); grep -rn Member $D", "allow"), ("grep -rn Member ${NOWHERE}", "allow"),
    ("grep -f <(echo Member) -rn Total Applications", "usage"), ("echo $(grep x y)\nrg Member", "usage"), ("echo start\ngrep -rn Member Applications", "usage"), ("cat x |\ngrep Member", "allow"),
    ("(cd docs)", "allow"), ("cd docs && grep -rn Member .", "allow"), ("cd Applications && rg Member", "usage"), ("git grep Member origin/main -- Applications", "allow"), ("git grep Member -- Applications", "usage"),
    ("grep -rn Member docs", "allow"), ("grep -rn Member scripts/run", "allow"), ("grep -rn Member web", "allow"), ("grep -rn Member Applications/Y.Controller", "usage"), ("grep -rn Member missing", "usage"), ("grep -rn Member /elsewhere", "allow"),
    ("grep Member docs/*", "allow"), ("grep Member Applications/X/*", "usage"), ("grep -rn Member Applications/*", "usage"), ("grep -rn -e Member Applications", "usage"), ("xargs -r grep Member", "usage"),
    (r"grep -rn Mem\ ber Applications", "usage"), ("grep -rn Member Applications\\", "allow"), ("echo $(echo ')') ; rg Member", "usage"), ("echo $(echo ')", "allow"), ("rg --context=3 Member", "allow"), ("rg Member 2>&1", "usage"), ("rg Member > out.cs", "usage"),
]
POWERSHELL = [
    ("gci -Recurse -Filter *.cs | Select-String 'class Member'", "declaration"), ("Select-String -Path Applications\\X\\*.cs -Pattern 'class Member'", "declaration"), ("Select-String -Path Applications\\X\\Foo.cs -Pattern '\\[Owner'", "allow"),
    ("gci Applications -Recurse -Include *.cs | sls Member", "usage"), ("sls Member -Path Applications\\X -Context 2", "allow"), ("Get-Content a.txt | Select-String Member", "allow"), ("Get-ChildItem -Recurse -Filter *.cs", "listing"),
    ("gci -r -Filter Foo.cs", "allow"), ("gci Applications\\X -Recurse -Filter *.cs", "allow"), ("$f = Applications\\X\\Foo.cs\nsls Member $f", "allow"), ("$f = gci | select -first 1\nsls Member $f.Name", "allow"), ("findstr /s /c:Member Applications\\*.cs", "usage"),
    ("dir -Recurse *Service*.cs", "listing"), ("gci Applications -Recurse -Exclude *.cs | sls Member", "allow"),
]
OTHER = [
    ("Grep", {"pattern": "class Member", "type": "cs"}, "declaration"), ("Grep", {"pattern": "Member", "glob": "*.cs"}, "usage"), ("Grep", {"pattern": "not found: title", "type": "cs"}, "declaration"), ("Grep", {"pattern": "No such title", "type": "cs"}, "usage"),
    ("Grep", {"pattern": "Mem.*Save", "type": "cs"}, "allow"), ("Grep", {"pattern": "Member", "glob": "*.cs", "-A": 2}, "allow"), ("Grep", {"pattern": "Member", "glob": "*.cs", "-A": None}, "usage"), ("Grep", {"pattern": "Member", "glob": "*.cs", "-i": True}, "allow"),
    ("Grep", {"pattern": "Member", "glob": "*.cs", "-i": False}, "usage"), ("Grep", {"pattern": "Member", "glob": "*.cs", "multiline": 1}, "allow"), ("Grep", {"pattern": "Member", "glob": "*.cs", "multiline": 0}, "usage"), ("Grep", {"pattern": "Member", "glob": "*.cs", "-i": ""}, "usage"),
    ("Grep", {"pattern": "Member", "glob": "*.cs", "-i": []}, "allow"), ("Grep", {"pattern": "Member", "path": "Applications/X/Foo.cs"}, "allow"), ("Grep", {"pattern": "Member", "path": "Applications/X/*.cs"}, "usage"), ("Grep", {"pattern": "Member", "glob": "*.ts"}, "allow"),
    ("Grep", {"pattern": "Member", "glob": "!*.cs"}, "allow"), ("Grep", {"pattern": "Member", "glob": "*.csv"}, "allow"), ("Grep", {"pattern": "Member", "glob": "*.{ts,cs}"}, "usage"), ("Grep", {"pattern": "Member", "path": "docs"}, "allow"), ("Grep", {"pattern": "Member"}, "usage"),
    ("Grep", {"pattern": ""}, "allow"), ("Grep", {"pattern": 7}, "allow"), ("Grep", {"pattern": "Member", "path": "/elsewhere"}, "allow"), ("Grep", {"pattern": "Member", "path": "../code/Applications"}, "usage"), ("Grep", {"pattern": "Member", "path": "~/x"}, "allow"),
    ("Glob", {"pattern": "**/*.cs"}, "listing"), ("Glob", {"pattern": "**/Foo.cs"}, "allow"), ("Glob", {"pattern": "Applications/X/**/*.cs"}, "allow"), ("Glob", {"pattern": "Components/*.cs"}, "listing"), ("Glob", {"pattern": "**/*.cs", "path": "Applications/X"}, "allow"), ("Glob", {"pattern": "**/*.csproj"}, "allow"),
    ("Read", {"file_path": "/work/code/Applications/X/Foo.cs"}, "read"), ("Read", {"file_path": "/WORK/code/applications/X/Foo.cs", "limit": 20}, "allow"), ("Read", {"file_path": "/work/code/Applications/Y.Controller/Z.cs"}, "allow"), ("Read", {"file_path": "/work/code/Applications/X/tool.py"}, "read"),
    ("Read", {"file_path": "/work/code/Applications/X/note.md"}, "allow"), ("Read", {"file_path": "/work/code/web/index.ts"}, "allow"), ("Read", {"file_path": "/work/code/none.cs"}, "allow"), ("Write", {"file_path": "x.cs"}, "allow"), ("Grep", "no object", "allow"),
]
