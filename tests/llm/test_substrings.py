"""The names that decide which windows are equal."""

import numpy as np

from wendgraph.llm import substrings, words


def thue_morse(n):
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x


def test_words_of_equal_polynomial_hashes_are_told_apart(spark):
    """Two words that every polynomial hash modulo 2**64 takes for one."""
    one = thue_morse(4096)
    two = one.translate(str.maketrans("ab", "ba"))
    h = words.words([one, two], "plain").hash
    assert one != two and h[0] != h[1]
    rest = " ".join(f"w{i}" for i in range(34))
    df = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, "x " + rest), (4, "x " + rest)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(df).collect()}
    assert got == {1: 0, 2: 0, 3: 35, 4: 35}


def test_window_names_are_those_of_the_words():
    a, b = "a b\tc  d\né f", "a  b c d é\x0bf g"
    one, two = substrings.window_names(a, np.arange(4), 3), substrings.window_names(b, np.arange(5), 3)
    assert (one == two[:4]).all() and len(np.unique(two, axis=0)) == 5
