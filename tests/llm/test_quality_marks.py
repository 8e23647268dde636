"""op10 counts characters in few passes over the whole text, and as a plain count does."""

import re
import unicodedata

from codelattice.llm import quality

TEXTS = ["", " \t\n", "Straße № 5, ½ Äpfel! #a|b <x> ~^ {y} \\z/ `q` (r) \"s\" 't' \u00a0\u2003end", "ÀÉ aeiou AEIOU ١٢٣ 漢字。 \U0001d400 \U0001f600 $1*2&3%4", "word " * 60 + "Iíİ ǅ"]


def test_character_classes(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "doc_id int, text string, lang string")
    counted = quality.counts(docs, [])
    plan = counted._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(text#") <= 3
    letters = {"upper": lambda c: unicodedata.category(c) == "Lu", "digit": lambda c: unicodedata.category(c)[0] == "N", "vowel": lambda c: c in "aeiou"}
    for r in counted.collect():
        text = TEXTS[r["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        each = [sum(map(letters.get(c) or (lambda x, p=p: bool(re.fullmatch(p, x))), text)) for c, p in quality.CLASSES.items()]
        total = sum(map(len, words))
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), total, len(re.findall(r"[#*$%&|<>]", text)))
        assert list(r["chars"]) == [*each, total - sum(each)]
