"""Changes read out of answers and applied: round trips with difflib, brute force for blocks, odd inputs."""

import difflib

from hypothesis import given, settings
from hypothesis import strategies as st

from lineloom.operators import patching

LINES = st.lists(st.sampled_from(["a", "b", "  c", "d();", "// note", "", "* x", "}", "-- e", "+ f"]), min_size=1, max_size=14)
SETTINGS = settings(max_examples=200, deadline=None)


@SETTINGS
@given(LINES, LINES, st.integers(1, 3))
def test_a_true_diff_gives_the_new_text(old, new, context):
    a, b = ("".join(x + "\n" for x in rows) for rows in (old, new))
    diff = "".join(difflib.unified_diff(a.splitlines(True), b.splitlines(True), "x", "x", n=context))
    assert patching.patched(a, diff, "diff") == ((b, None, []) if diff else (a, None, []))


@SETTINGS
@given(LINES, st.integers(0, 13), st.integers(0, 13))
def test_the_last_equal_block_is_replaced(rows, i, j):
    text = "".join(x + "\n" for x in rows)
    some = rows[min(i, j) : max(i, j) + 1]
    block = "".join(x + "\n" for x in some)
    got = patching.replace_last(text, block, "NEW\n")
    if some:
        at = max(k for k in range(len(text)) if text.startswith(block, k))
        assert got == text[:at] + "NEW\n" + text[at + len(block) :]
    else:
        assert got is None


def test_a_deleted_and_an_added_line_that_look_like_file_headers_are_taken_for_them():
    assert patching.patched("-- e\n", "@@ -1 +1 @@\n--- e\n+++ f\n", "diff") == ("-- e\n", None, [])


def test_odd_changes():
    assert patching.patched("a\n", "", "diff") == ("a\n", None, [])
    assert patching.patched("", "@@ -1 +1 @@\n-a\n+b", "diff") == ("", None, [1])
    assert patching.patched("", "@@ -0,0 +1 @@\n+b", "diff") == ("b\n", None, [])
    assert patching.patched("a\n", "<<< SEARCH\na\n===\nb\n", "part") == ("a\n", None, [])  # a block that isn't closed is none
    long = "".join(f"line {i}\n" for i in range(20_000))
    assert patching.patched(long, "@@ -1 +1 @@\n-line 19999\n+x", "diff")[0].endswith("line 19998\nx\n")


def test_rows_with_nulls_and_columns_of_their_own(spark):
    df = spark.createDataFrame([(1, None, "x", "full"), (2, "a\n", None, "diff"), (3, "a\n", "b", None)], "patch_id int, text string, change string, way string")
    got = {r["patch_id"]: tuple(r["patch"]) for r in patching.apply_changes(df).collect()}
    assert got == {1: ("x", None, []), 2: ("a\n", None, []), 3: ("a\n", "unknown way ", [])}
    assert patching.apply_changes(df.limit(0)).count() == patching.diff_hunks(df.limit(0), "change").count() == patching.answers(df.limit(0)).count() == 0
