"""Words of the decontamination contract against its regular expression."""

import re

from pyspark.sql import functions as F

from kgenrich.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_words_equal_the_pattern(spark):
    texts = ["", " ", "a", "  A  b ", "Ab,cD.e!!", "x\x00y\x00\x00", "\x00", "ÄÖ ß\u00a0É", "a\tb\nc\r\x0bd", "😀 _a-b_ {z}~\x7f9",
             "".join(map(chr, range(256))), "[^`@A" * 50, "\u2003wide\u3000space", "0123456789:;", "\x1c\x1d q"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    got = {r.i: r.w for r in df.select("i", decontam.words(F.col("t")).alias("w")).collect()}
    for i, t in enumerate([*texts, None]):
        assert got[i] == WORD.findall((t or "").translate(AZ)), repr(t)
