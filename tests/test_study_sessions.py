"""Session names of study files."""

from tidewatch.sources.study import read_sessions


def test_names_without_a_regular_expression(spark, tmp_path):
    for name in ("a.csv", "b.csv.csv", "c", "d.csvx"):
        (tmp_path / name).write_text("phase,alert_idx\nbaseline,1,attack,2.5,1,1,\n\nquestionnaire,q1,q2\nanswer,3,\n")
    d, a = read_sessions(spark, str(tmp_path))
    assert sorted(r.session for r in d.collect()) == ["a", "b.csv", "c", "d.csvx"]
    assert sorted((r.session, r.question, r.answer) for r in a.where("answer is not null").collect()) == [(s, "q1", 3) for s in ("a", "b.csv", "c", "d.csvx")]
    # tried at every start of the path, for every line
    assert "regexp_extract" not in d._jdf.queryExecution().toString()
