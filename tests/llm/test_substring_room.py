"""What substring dedup stores on the way."""

from lodestone.llm import substring_dedup as S


def test_suffixes_of_whole_groups_are_not_stored(spark, monkeypatch):
    passage = " ".join(f"w{k}" for k in range(50))
    rows = [(i, f"{passage} only{i}") for i in range(6)] + [(9, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    stored, stage = {}, S.stage

    def counted(table, label):
        out = stage(table, label)
        stored[label] = out.count()
        return out

    monkeypatch.setattr(S, "stage", counted)
    gone = {r.doc_id: r.n_removed for r in S.remove_repeats(df).collect()}
    assert gone == {i: 50 for i in range(6)} | {9: 0} and stored["suffixes"] == 0
    # in parts they are read again, and stored
    gone = {r.doc_id: r.n_removed for r in S.remove_repeats(df, group_cap=2).collect()}
    assert gone == {i: 50 for i in range(6)} | {9: 0} and stored["suffixes"] > 0
