"""The generated source files hold every word of the texts they come from."""

import re
from collections import Counter

from pyspark.sql import functions as F

from quarry.catalogue.code import corpus
from quarry.plans.extract import extract

LONG = " ".join(f"w{chr(97 + i % 26)}" for i in range(5000))
TEXTS = [None, "", "123 -- !", "one", "one two", "one two three", "Über zwei drei vier fünf", "a b c d\n\ne\nf g\nh i j k l", LONG, "same same same same", "a\r\nb\tc d\r\n"]


def _named(words: list[str]) -> list[str]:
    return [words[min(i, len(words) - 1)] for i in range(3)] + words[3:]


def _files(spark, tmp_path):
    rows = [(i, TEXTS[i // 6]) for i in range(6 * len(TEXTS))]  # every text in every language
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return dict(rows), corpus(spark, str(tmp_path))


def test_all_words_stand_in_the_files(spark, tmp_path):
    texts, files = _files(spark, tmp_path)
    found = {int(re.search(r"/m(\d+)\.", r["path"])[1]): r["text"] for r in files.collect()}
    for doc, text in texts.items():
        if text is None:
            assert found[doc] is None
            continue
        lines = [w for w in (re.findall("[a-z]+", line.lower()) for line in text.split("\n")) if w]
        body = found[doc].split("\n", 1)[1] if doc % 6 == 0 else found[doc]  # behind the import
        assert Counter(a or b for a, b in re.findall(r"\bf_([a-z]+)|\b([a-z]+)\(\)", body)) == Counter(w for line in lines for w in _named(line))


def test_words_in_comments_are_no_calls(spark, tmp_path):
    texts, files = _files(spark, tmp_path)
    out = extract(files)
    assert out["refs"].where(~F.startswith("target_name", F.lit("f_")) & (F.col("via") == "call")).count() == 0
    lines = {d: [w for w in (re.findall("[a-z]+", x.lower()) for x in (t or "").split("\n")) if w] for d, t in texts.items()}
    docs = Counter((r["path"], r["docstring"]) for r in out["symbols"].where("kind = 'method' AND lang = 'python'").collect())
    paths = {int(re.search(r"/m(\d+)\.", r["path"])[1]): r["path"] for r in files.select("path").collect()}
    assert docs == Counter((paths[d], " ".join(f"{v}()" for v in w[3:])[:400]) for d, ws in lines.items() if d % 6 == 0 for w in ws)
