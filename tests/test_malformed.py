import csv
import io
import itertools

from pyspark.sql import Row

from molquarry.operators.malformed import error_parse, judge, loaded, parse_lines, rejected, report


def reason(line):
    return judge(line, -50, 50)[2]


def test_reasons_in_order():
    cases = {
        "CCO,1.5": None, '"CCO","1.5"': None, "CCO,": None, "CCO,\r": None, "CCO, +1e1 ": None, "CCO,1.": None, "CCO,-.5": None,
        '"CCO,1': "quoting", 'CCO",1': "quoting", '"CCO"x,1': "quoting", 'C"C,1,2': "quoting", '"CCO" ,1': "quoting",
        "": "columns", "CCO": "columns", "CCO,1,2": "columns", "CCO;1": "columns", "C(,1,": "columns",
        ",1": "smiles", "C(,x": "smiles", '"C""C",1': "smiles", " CCO,1": "smiles",
        "CCO,x": "expt", "CCO,51": "expt", "CCO,nan": "expt", "CCO,-": "expt", "CCO,1e": "expt", "CCO,−3": "expt", 'CCO,"1,2"': "expt",
    }
    for line, want in cases.items():
        assert reason(line) == want, line


def _apply(line, edits):
    """Undo edits from the back, so that earlier places stay right."""
    for e in reversed(edits):
        what, at = e.rsplit(" at ", 1)
        at = int(at)
        mark = '"' if "quote" in what else ","
        line = line[:at] + mark + line[at:] if what.startswith("insert") else line[:at] + line[at + 1 :]
    return line


def test_edits_repair_every_short_line_and_cost_is_least():
    def sound(s):
        try:
            rows = list(csv.reader(io.StringIO(s), strict=True))
        except csv.Error:
            return False
        return error_parse(s)[:2] == (0, 0) and len(rows or [[]]) == 1

    for n in range(6):
        for chars in itertools.product('a",', repeat=n):
            line = "".join(chars)
            q, d, edits = error_parse(line)
            assert bool(edits) == bool(q + d)
            assert error_parse(_apply(line, edits))[:2] == (0, 0), line
            if (q, d) == (0, 0):
                assert sound(line)
                assert len(next(csv.reader(io.StringIO(line)))) == 2


def test_frame(spark):
    rows = [Row(line_id=1, line="CCO,1", reason="x", smiles=3), Row(line_id=2, line=None, reason="x", smiles=3), Row(line_id=3, line='"' + "C" * 200_000, reason="y", smiles=4), Row(line_id=1, line="CCO,1", reason="x", smiles=3)]
    p = parse_lines(spark.createDataFrame(rows))
    assert sorted(map(tuple, rejected(p).collect())) == [(2, "columns"), (3, "quoting")]
    assert [tuple(r) for r in loaded(p).collect()] == [(1, "CCO", 1.0)] * 2
    assert dict(map(tuple, report(p).collect())) == {"valid": 2, "columns": 1, "quoting": 1}
    assert parse_lines(spark.createDataFrame([], "line_id long, line string")).count() == 0
