import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuskiln.sources import rejects as R

GOOD = "12\t2015-02-28 10:00:00\tja\t안녕\t안녕!"
CASES = [
    (GOOD, None), (GOOD + "\r", None), (GOOD + "\r\r", "value"), ("", "column_count"), (None, "column_count"), ("\r", "column_count"),
    ("1\t2\t3", "column_count"), (GOOD + "\tx", "column_count"), ('"12"\t2015-02-28 10:00:00\t\t"a\tb"\tx"y', None),
    ('12\t2015-02-28 10:00:00\t\t"a"" b"\tc', None), ('12\t2015-02-28 10:00:00\t\t"a"b\tc', "quoting"), ('12\t"x', "quoting"), ('"', "quoting"),
    ("0\t2015-02-28 10:00:00\t\ta\tb", "value"), ("+1\t2015-02-28 10:00:00\t\ta\tb", "value"), ("١\t2015-02-28 10:00:00\t\ta\tb", "value"),
    ("007\t2015-02-28 10:00:00\t\ta\tb", None), ("12\t2015-02-29 10:00:00\t\ta\tb", "value"), ("12\t2015-2-28 10:00:00\t\ta\tb", "value"),
    ("12\t2015-02-28 24:00:00\t\ta\tb", "value"), ("12\t0000-02-28 10:00:00\t\ta\tb", "value"), ("12\t2015-02-28T10:00:00\t\ta\tb", "value"),
    ("12\t2015-02-28 10:00:00\t\t 　\tb", "value"), ("12\t2015-02-28 10:00:00\t\ta\t", "value"), ("12\t2015-02-28 10:00:00\t\ta�\tb", "value"),
    ("12\t2015-02-28 10:00:00\t\ta\x07\tb", "value"), ("12\t2015-02-28 10:00:00\t\ta\x85\tb", "value"), ('12\t2015-02-28 10:00:00\t\t"\t"\tb', "value"),
    ("99999999999999999999\t2015-02-28 10:00:00\t\ta\tb", None),
]


def outcome(lines):
    """Reasons by the columnar path and bisection."""
    return [reason for _, n, reason, _ in R._blocks(pa.array(lines, pa.string()), 0) for _ in range(n)]


def test_reasons():
    for line, reason in CASES:
        assert R.diagnose(line)[0] == reason, line
    assert outcome([line for line, _ in CASES]) == [r for _, r in CASES]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([c[0] for c in CASES if c[0] is not None]), st.text('"\t ab1\r\n', max_size=12).map(lambda t: "3\t2015-02-28 10:00:00\t\ta\t" + t)), max_size=12))
def test_bisection_agrees_with_the_strict_parser(lines):
    assert outcome(lines) == [R.diagnose(x)[0] for x in lines]


def test_loading(spark):
    rows = [(i, "f", i, line, "clash") for i, (line, _) in enumerate(CASES)]
    lines = spark.createDataFrame(rows, "line_id long, file_name string, line_no int, line string, reason string")
    bad = {(r.line_id, r.reason) for r in R.rejected(lines).collect()}
    assert bad == {(i, r) for i, (_, r) in enumerate(CASES) if r}
    good = {r.line_id: r for r in R.loaded(lines).collect()}
    assert set(good) == {i for i, (_, r) in enumerate(CASES) if not r}
    assert good[0].pair_id == 12 and good[0].original == "안녕" and str(good[0].posted_at) == "2015-02-28 10:00:00"
    assert good[8].original == "a\tb" and good[8].corrected == 'x"y' and good[9].original == 'a" b'
    assert good[len(CASES) - 1].pair_id is None
    assert R.rejected(lines.limit(0)).count() == 0
