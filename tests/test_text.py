import re

from pyspark.sql import functions as F

from argentum.functions.text import fold


def test_fold_of_every_ascii_character(spark):
    texts = [f"A{chr(c)}b{chr(c)}{chr(c)}C9" for c in range(1, 128)] + ["", " x ", "Ärger_É~1"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(fold(F.col("t"))).collect()]
    assert got[:-1] == [re.sub(r"[^a-z0-9~]+", " ", t.lower()).strip(" ") for t in texts[:-1]] and got[-1] == "arger e~1"
