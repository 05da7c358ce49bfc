"""The record grammar, against a plain reading of the format, and its errors and recovery."""

from hypothesis import given
from hypothesis import strategies as st

from treeline.operators import record_lines as R

GOOD = "rpi1:BR1;pt;2020-02-29;A01B 1/02|A01B;T;some text;src;abstract|x"


def reason(line, sep=";"):
    out = R.parse_line(line, sep)
    return out[0].get("reason") if out else "blank"


def test_good_and_blank():
    assert reason(GOOD) is None and reason(GOOD + "\r") is None
    assert [reason(x) for x in (None, "", "  ", "\t\r", "\r")] == ["blank"] * 5
    r = R.parse_line(GOOD, ";")[0]
    assert r["ipc"] == ["A01B0001020000", "A01B"] and r["tags"] == ["abstract", "x"]
    assert reason('rpi1:B;pt;2020-01-01;A;"a ""q"";\n";;s;') is None


def test_reasons():
    f = GOOD.split(";")
    put = lambda i, v: ";".join([*f[:i], v, *f[i + 1 :]])
    assert reason(put(4, 'a"b')) == reason(put(4, '"ab')) == reason(put(4, '"a"b')) == reason(put(4, ' "a"')) == "quoting"
    assert reason(GOOD + ";") == reason(";".join(f[:7])) == "columns"
    assert reason(put(4, 'a"b') + ";x") == "quoting" and reason(put(2, "2020-02-30") + ";x") == "columns"
    for i, v in ((2, "2019-02-29"), (2, "2020-2-9"), (2, ""), (2, "2020-02-29 "), (3, "A01B||A"), (3, ""), (3, "nothing"), (5, " "), (5, "a�"), (5, "a\x07"), (5, "a\x7f"), (7, "x"), (7, "")):
        assert reason(put(i, v)) == "value", (i, v)
    assert reason(put(5, "a\tb")) is None and reason(put(5, '"a\nb"')) is None
    assert reason(GOOD.replace(";", "\t"), "\t") is None and reason(GOOD.replace(";", ","), ",") is None


def test_recovery_and_places():
    bad = 'rpi1:B;pt;2020-01-01;A;"open;x;s;title-only\n' + GOOD
    out = R.parse_line(bad, ";")
    assert out[0]["reason"] == "quoting" and out[0]["error_column"] == 4 and out[0]["error_at"] == bad.index('"')
    assert len(out) == 2 and out[1]["recovered"] and out[1]["id"] == "rpi1:BR1"


@given(st.lists(st.text(st.sampled_from('ab";\n"" '), max_size=6), min_size=1, max_size=9))
def test_round_trip(fields):
    line = ";".join('"' + f.replace('"', '""') + '"' for f in fields)
    got, _, bad = R.grammar(";").record(line, 0)
    assert bad is None and got == fields


@given(st.text(st.sampled_from('a";\n'), max_size=12))
def test_quoting_by_state_machine(line):
    """The same by a machine over characters."""
    state, fields, ok = "start", 1, True
    for i, c in enumerate(line):
        if state == "start":
            state = "in" if c == '"' else "bare" if c != ";" else "start"
            fields += c == ";"
        elif state == "bare":
            ok &= c != '"'
            if c == ";":
                state, fields = "start", fields + 1
        elif state == "in":
            state = "quote" if c == '"' else "in"
        elif c == '"':
            state = "in"
        elif c == ";":
            state, fields = "start", fields + 1
        else:
            ok = False
    ok &= state != "in"
    got, _, bad = R.grammar(";").record(line, 0)
    assert (bad is None) == ok and (not ok or len(got) == fields)


def test_table(spark):
    rows = [(1, ";", GOOD, "x"), (2, None, GOOD, "x"), (3, ";", None, "x"), (4, ";", "nothing", "x"), (4, ";", "nothing", "x")]
    lines = spark.createDataFrame(rows, "line_id long, sep string, line string, reason string")
    assert sorted((r.line_id, r.reason) for r in R.bad_lines(lines).collect()) == [(4, "columns"), (4, "columns")]
    assert sorted(r.line_id for r in R.good_records(lines).collect()) == [1, 2]
    assert R.parse_lines(lines.limit(0)).count() == 0
