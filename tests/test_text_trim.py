"""Stripping by a list of characters, against the pattern it stands for."""

import random
import re
import time

from pyspark.sql import functions as F

from siltstone.functions import text


def test_same_as_the_pattern_and_not_quadratic(spark):
    rng = random.Random(5)
    chars = list(text.WHITE_CHARS) + list("ab.#?\x1c​﻿é猫\n\r")
    made = ["".join(rng.choice(chars) for _ in range(rng.randrange(12))) for _ in range(400)] + ["", " \n", "x\r\n", "\u0085x "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*made, None])], "i int, t string")
    by_pattern = F.regexp_replace("t", rf"^{text.WHITE}+|{text.WHITE}+$", "")
    assert df.filter(~text.stripped(F.col("t")).eqNullSafe(by_pattern)).count() == 0
    want = [bool(len(s) < 25 or (s.startswith("#") and "\n" not in s) or s.endswith(("?", "？"))) for s in (re.sub(rf"^{text.WHITE}+|{text.WHITE}+$", "", t, flags=re.ASCII) for t in made)]
    assert [r["x"] for r in df.filter("t is not null").orderBy("i").select(text.title_only(F.col("t")).alias("x")).collect()] == want
    began = time.time()
    wide = spark.range(8).select(F.concat(F.lit("a"), F.repeat(F.lit(" "), 200_000), F.lit("b")).alias("t"))
    assert wide.filter(F.char_length(text.stripped(F.col("t"))) == 200_002).count() == 8
    assert time.time() - began < 30  # the pattern takes minutes
