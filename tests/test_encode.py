import pytest
from pyspark.sql import functions as F

from epiframe.functions.alphabet import RESIDUE_CODES
from epiframe.functions import (assemble, encode_letters, multi_hot, one_hot, pad_middle,
                                peptide_vector, strip_blanks)


@pytest.mark.parametrize("seq, want", [
    ("", [0] * 11),
    ("A", [0] * 10 + [1]),
    ("AC", [1] + [0] * 9 + [2]),
    ("ACD", [1] + [0] * 8 + [2, 3]),
    ("ACDEFGHI", [1, 2, 3, 4, 0, 0, 0, 5, 6, 7, 8]),
    ("ACDEFGHIK", [1, 2, 3, 4, 0, 0, 5, 6, 7, 8, 9]),
    ("ACDEFGHIKLM", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]),
    ("ACDEFGHIKLMN", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]),  # longer ones are not cut
    ("AZOUY", [1, 0] + [0] * 6 + [21, 22, 20]),
])
def test_pad_middle_by_length(spark, seq, want):
    df = spark.createDataFrame([(seq,)], "s string")
    assert df.select(peptide_vector("s").alias("v")).first()["v"] == want


def test_letters_codes_and_unknown(spark):
    df = spark.createDataFrame([("ZOU",), ("AbC",), ("AXC",)], "s string")
    got = [r[0] for r in df.select(encode_letters("s", strict=False)).collect()]
    assert got[0] == [0, 21, 22]
    assert got[1] == [1, None, 2]          # lower case is not a residue letter
    assert got[2] == [1, None, 2]
    with pytest.raises(Exception, match="unknown residue"):
        df.select(encode_letters("s")).collect()


def test_strip_blanks_like_python(spark):
    rows = [(" \tAC\r\n",), ("AC",), ("\t",), ("\xa0A C\u3000\x0b",), ("\x1cAC\x85",)]
    df = spark.createDataFrame(rows, "s string")
    got = [r[0] for r in df.select(strip_blanks("s")).collect()]
    assert got == [r[0].strip() for r in rows]


def test_one_hot_out_of_range_is_zero_row(spark):
    df = spark.createDataFrame([([0, 2, 22],)], "c array<int>")
    got = df.select(one_hot("c", 21, flatten=False)).first()[0]
    assert got[0][0] == 1 and sum(got[0]) == 1
    assert got[1][2] == 1 and sum(got[1]) == 1
    assert sum(got[2]) == 0
    flat = df.select(one_hot("c", 21)).first()[0]
    assert len(flat) == 63
    fixed = df.select(one_hot("c", 21, width=3)).first()[0]
    assert fixed == flat
    other = df.select(one_hot("c", 21, width=5)).first()[0]   # other length: general form
    assert other == flat


def test_multi_hot_counts_duplicates(spark):
    df = spark.createDataFrame([([3, 3, 5, 0, 101, 7],)], "c array<int>")
    got = df.select(multi_hot("c", 100)).first()[0]
    assert len(got) == 100 and got[2] == 2 and got[4] == 1 and got[6] == 1
    assert sum(got) == 4          # code 0 and codes above n count nowhere


def test_assemble_width_check(spark):
    df = spark.createDataFrame([("ACDEFGHI", [1, 2, 3, 4, 5, 6], 0.5),
                                ("ACDEFGHIKLMN", [1, 2, 3, 4, 5, 6], 0.5)],
                               "s string, c array<int>, a double")
    first = df.filter(F.length("s") == 8)
    ok = first.select(assemble([peptide_vector("s"), "c"], width=17)).first()[0]
    assert len(ok) == 17
    with pytest.raises(Exception, match="width is not 17"):
        df.select(assemble([peptide_vector("s"), "c"], width=17)).collect()
    lax = [r[0] for r in df.select(assemble([peptide_vector("s"), "c"], width=17,
                                            strict=False)).collect()]
    assert lax[1] is None
    v18 = first.select(assemble([peptide_vector("s"), "c", F.array("a")], width=18,
                                      as_double=True)).first()[0]
    assert len(v18) == 18 and v18[-1] == 0.5 and isinstance(v18[0], float)


def test_pad_middle_keeps_letter_order(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    letters = "ACDEFGHIKLMNPQRSTVWY"

    @settings(max_examples=25, deadline=None)
    @given(st.text(alphabet=letters, min_size=0, max_size=11))
    def check(seq):
        df = spark.createDataFrame([(seq,)], "s string")
        got = df.select(pad_middle(encode_letters("s"))).first()[0]
        codes = [RESIDUE_CODES[c] for c in seq]
        half = len(seq) // 2
        assert len(got) == 11
        assert got[:half] == codes[:half]                        # left half in front
        assert got[11 - (len(seq) - half):] == codes[half:]      # the rest at the end
        assert not any(got[half:11 - (len(seq) - half)])         # zeros between

    check()
